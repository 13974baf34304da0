import os

import pytest

from twinsift.plans import workspace as W


def test_tables_texts_and_clearing(spark):
    work = W.Workspace(spark, "t")
    df = work.save(spark.range(3), "a")
    assert df.count() == 3 and work.save(spark.range(0), "b").count() == 0
    work.write_text("state.json", "one")
    work.write_text("state.json", "twö")
    assert work.read_text("state.json") == "twö"
    work.drop("a")
    folder = work.root.removeprefix("file://")
    assert not os.path.exists(f"{folder}/a") and os.path.exists(f"{folder}/b")
    kept = W.Workspace(spark, "t", f"{work.root}-kept")
    kept.save(spark.range(1), "c")
    assert W.clear_workspaces(spark) >= 1 and not os.path.exists(folder)
    assert kept.spark.read.parquet(kept.path("c")).count() == 1


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        applicationId = "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError):
        W.shared_folder(Session())
    Session.sparkContext.master = "local[4]"
    folder = W.shared_folder(Session())
    assert folder.startswith("file://") and W.shared_folder(Session()) == folder

import random
from pathlib import Path

from twinsift.constants import HASH_KINDS
from twinsift.operators import blocks
from twinsift.operators import similarity as S
from twinsift.plans.workspace import Workspace


def shuffle_files(spark):
    """Bytes of shuffle files that are not deleted yet."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*") if p.is_file())


def test_shuffles_of_written_tables_are_let_go(spark):
    work = Workspace(spark, "t")
    work.free()
    before = shuffle_files(spark)
    work.save(spark.range(300_000).repartition(4, "id"), "x")
    assert shuffle_files(spark) > before
    work.free()
    assert shuffle_files(spark) <= before


def pictures(spark, count):
    rng, rows = random.Random(4), []
    for i in range(count):
        v = [rng.getrandbits(256) for _ in range(4)] if i % 2 == 0 else [b ^ 1 << rng.randrange(256) for b in rows[-1][1]]
        rows.append((f"/{i:05d}", v))
    return spark.createDataFrame([(p, *[f"{x:064x}" for x in v]) for p, v in rows], ", ".join(f"{c} string" for c in ("path", *HASH_KINDS)))


def test_turns_hold_every_cell_once():
    for n in (1, 4, 5, 17):
        parts = blocks.turns(n)
        assert sorted(c for part in parts for c in part) == [(p, q) for p in range(n) for q in range(p, n)]
        assert max(sum(1 + (p != q) for p, q in part) for part in parts) <= blocks.COPIES * n + 1


def test_blocks_in_turns(spark, monkeypatch):
    df = pictures(spark, 300)
    want = sorted(S.image_pairs(df, 0.9).collect())
    monkeypatch.setattr(blocks, "MOST_ROWS", 25)
    sent, whole = [], blocks._spread_cells
    monkeypatch.setattr(blocks, "_spread_cells", lambda rows, *a: (sent.append(rows.count()), whole(rows, *a))[1])
    assert sorted(S.image_pairs(df, 0.9).collect()) == want and len(want) == 150
    # 12 blocks send 12 copies of every row, never more than a third of them at once
    assert sum(sent) == 12 * 300 and max(sent) < 1.25 * blocks.COPIES * 300


def stored(spark):
    from twinsift.plans import workspace

    return sum(p.stat().st_size for root in workspace._made for p in Path(root.removeprefix("file://")).rglob("*.parquet"))


def test_groups_keep_no_hash_texts(spark):
    from twinsift.operators.groups import near_image_groups

    df = pictures(spark, 1_000).localCheckpoint()
    before = stored(spark)
    groups = near_image_groups(df, 0.9)
    # four texts of 64 digits a row would be 256 KB, and again in every table that holds them
    assert stored(spark) - before < 200_000
    assert groups.count() == 1_000 and groups.where("leader <> path").count() == 500


def test_settled_runs_leave_nothing_but_the_result(spark):
    from twinsift.plans import workspace

    work, before = Workspace(spark, "outer"), len(workspace._made)
    got = work.settle(lambda: Workspace(spark, "inner").save(spark.range(10), "x"), "result")
    assert got.count() == 10 and len(workspace._made) == before


def test_classes_tell_missing_from_empty_texts(spark):
    from twinsift.operators.groups import class_members

    rows = [("a", None, "", None, None), ("b", "", None, None, None), ("c", "1", "2", None, ""), ("d", "1,1:2", None, None, ""), ("e", None, "", None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("path", *HASH_KINDS)))
    got = {r["path"]: (r["class"], r["copies"]) for r in class_members(df, Workspace(spark, "t"), 5).collect()}
    assert got == {"a": ("a", 2), "b": ("b", 1), "c": ("c", 1), "d": ("d", 1), "e": ("a", 2)}


def test_numbered_members_keep_only_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from twinsift.plans import queries as Q

    rows = pictures(spark, 1_000)
    for c, kind in (("ingested_at", "timestamp"), ("scanned_at", "timestamp"), ("width", "int"), ("height", "int")):
        rows = rows.withColumn(c, F.lit(None).cast(kind))
    rows.withColumn("file_size", F.substring("path", 2, 5).cast("long")).write.parquet(f"{tmp_path}/images.parquet")
    before = stored(spark)
    got = Q.numbered_near_members(spark, str(tmp_path)).collect()
    # no table of hashes is left: 256 KB of texts
    assert stored(spark) - before < 100_000
    assert sorted((r["group_id"], r["path"], r["rank"]) for r in got) == sorted((i // 2 + 1, f"/{i:05d}", 2 - i % 2) for i in range(1_000))

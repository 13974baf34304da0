import random
import uuid

from twinsift.llm import knn


def test_graphs_of_any_number_of_tables_are_searched_alike(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    rows = [(i, *[f"{rng.getrandbits(256):064x}" for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    folder, search = str(tmp_path), knn.near_pairs

    def noted(vectors, ids, *settings, **named):
        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write(repr((settings, named)))
        return search(vectors, ids, *settings, **named)

    monkeypatch.setattr(knn, "near_pairs", noted)
    assert knn.plan_tables(200, 76, 768, 25, 0.93)[1] >= 3
    for shard_rows in (8_000, 25):
        knn.similar_vectors(df, "id", ["a", "b", "c"], shard_rows=shard_rows).count()
    assert len(list(tmp_path.iterdir())) > 3
    assert len({p.read_text() for p in tmp_path.iterdir()}) == 1

import random

from twinsift.llm import incremental as inc


def heap(spark, collect):
    """MB of this process's Java heap in use, garbage that is not collected yet included."""
    if collect:
        spark._jvm.System.gc()
    run = spark._jvm.java.lang.Runtime.getRuntime()
    return (run.totalMemory() - run.freeMemory()) / 1e6


def test_a_step_leaves_no_garbage_in_the_driver(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(256) for _ in range(150)]
    rows = [(i, 1 + i // 100, f"{base[i % 150] ^ 1 << rng.randrange(256):064x}", "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, batch_no int, h string, format string, bytes long")
    df = df.select("id", "batch_no", *inc.word_columns(inc.F.col("h")), "format", "bytes")
    monkeypatch.setattr(inc, "STEP_ROWS", 0)
    monkeypatch.setattr(inc, "STEP_SHARE", 0)
    history = inc.History.create(spark, str(tmp_path / "h"), "image", expected=100, batch=100)
    left, finish = [], history.finish

    def measured():
        finish()
        left.append(heap(spark, False) - heap(spark, True))

    monkeypatch.setattr(history, "finish", measured)
    done = inc.deduplicate_batches(history, df, None)
    assert {r["id"]: r["keeper"] for r in done.where("keeper is not null").collect()} == {150 + i: i for i in range(150)}
    assert len(left) == 3 and max(left) < 40, left

import random

import pytest

from twinsift.constants import HASH_KINDS
from twinsift.operators import blocks
from twinsift.operators.groups import image_groups
from twinsift.operators.similarity import image_pairs


def shuffled_records(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def pictures(count, hot):
    """Rows of which ``hot`` share a pHash; some lack a kind, some are near copies in all kinds."""
    rng = random.Random(9)
    shared, rows = rng.getrandbits(256), []
    for i in range(count):
        v = [shared if i < hot else rng.getrandbits(256), *[rng.getrandbits(256) for _ in range(3)]]
        if i % 3 == 1:
            v = [None if b is None else b ^ (1 << rng.randrange(256)) ^ (1 << rng.randrange(256)) for b in rows[-1][1]]
        if i % 5 == 2:
            v[rng.randrange(1, 4)] = None
        rows.append((f"/{i:05d}", v))
    return rows


@pytest.mark.parametrize("large", [0, 200_000])
def test_pairs_by_several_kinds(spark, monkeypatch, large):
    import twinsift.operators.blocks as B

    rows = pictures(60, 30)
    sims = lambda a, b: [1 - (x ^ y).bit_count() / 256 for x, y in zip(a, b) if x is not None and y is not None]
    want = {(p, q): sum(s) / len(s) for p, a in rows for q, b in rows if p < q and (s := sims(a, b)) and sum(s) / len(s) >= 0.9}
    assert want
    if large == 0:
        # in this process, where the limit can be set
        import numpy as np
        import pyarrow as pa

        monkeypatch.setattr(B, "LARGE", 0)
        columns = {"n": list(range(60)), "code": [int("".join("0" if x is None else "1" for x in v), 2) for _, v in rows]}
        for k, kind in enumerate(HASH_KINDS):
            for w in range(4):
                columns[f"{kind}_w{w}"] = np.array([0 if v[k] is None else v[k] >> 64 * (3 - w) & (1 << 64) - 1 for _, v in rows], np.uint64).view(np.int64)
        table = pa.table(columns)
        compare = blocks.image_pairs(HASH_KINDS, [256], 4, [25], 0.9, False)
        got = [r for b in compare(table, None) for r in b.to_pylist()]
        assert {(rows[r["x"]][0], rows[r["y"]][0]): r["similarity"] for r in got} == want and len(got) == len(want)
        two = [table.slice(0, 31), table.slice(31)]
        across = [(r["x"], r["y"]) for b in compare(*two) for r in b.to_pylist()]
        assert sorted(across) == sorted((int(p[1:]), int(q[1:])) for p, q in want if p <= "/00030" < q)
    else:
        df = spark.createDataFrame([(p, *[None if x is None else f"{x:064x}" for x in v]) for p, v in rows], ", ".join(f"{c} string" for c in ("path", *HASH_KINDS)))
        got = image_pairs(df, 0.9).collect()
        assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_groups_shuffle_no_look_ups(spark):
    rows = pictures(1_500, 0)
    df = spark.createDataFrame([(p, *[None if x is None else f"{x:064x}" for x in v]) for p, v in rows], ", ".join(f"{c} string" for c in ("path", *HASH_KINDS)))
    before = shuffled_records(spark)
    assert image_groups(df, 0.9, "phash").count() > 0
    assert shuffled_records(spark) - before < 30 * len(rows)

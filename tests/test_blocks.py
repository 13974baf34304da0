import random

import numpy as np
import pytest

from twinsift.operators import blocks
from twinsift.operators import hamming as H
from twinsift.plans.workspace import Workspace


def shuffled_records(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_look_ups_are_not_shuffled(spark):
    rng = random.Random(5)
    held = [rng.getrandbits(256) for _ in range(3_000)]
    rows = [(i, *[(v >> 64 * (3 - w) & (1 << 64) - 1) - (1 << 63) for w in range(4)]) for i, v in enumerate(held)]
    table = spark.createDataFrame(rows, "node long, w0 long, w1 long, w2 long, w3 long")
    before = shuffled_records(spark)
    assert H.near_pairs(table, 256, 25, Workspace(spark, "t")).collect() == []
    assert shuffled_records(spark) - before < 10 * len(rows)


@pytest.mark.parametrize("bits,most", [(64, 12), (100, 8), (256, 25), (256, 38), (64, 40)])
@pytest.mark.parametrize("way", ["planned", "all", "wide"])
def test_pairs_of_a_cell(monkeypatch, bits, most, way):
    rng = random.Random(bits + most)
    x = [rng.getrandbits(bits) for _ in range(40)]
    for v in x[:30]:
        for b in rng.sample(range(bits), rng.choice([1, most, most + 1])):
            v ^= 1 << b
        x.append(v)
    y = x[5:50] + [rng.getrandbits(bits) for _ in range(20)]
    monkeypatch.setattr(blocks, "HELD", 50)
    monkeypatch.setattr(blocks, "PAIR_COST", 1e-9 if way == "all" else 1e9)
    if way == "wide":
        monkeypatch.setattr(blocks, "TABLE_BITS", 3)
    blocks.plan_cell.cache_clear()
    words = lambda vs: [np.array([v >> 64 * (-(-bits // 64) - 1 - w) & (1 << 64) - 1 for v in vs], np.uint64) for w in range(-(-bits // 64))]
    found = lambda *a: sorted(zip(*[np.concatenate(c).tolist() for c in zip(*blocks.near_indices(*a, bits, most))]))
    direct = lambda u, v: [(i, j, (a ^ b).bit_count()) for i, a in enumerate(u) for j, b in enumerate(v) if (a ^ b).bit_count() <= most]
    assert found(words(x), words(y)) == direct(x, y)
    assert found(words(x), None) == [t for t in direct(x, x) if t[0] < t[1]]
    blocks.plan_cell.cache_clear()


@pytest.mark.parametrize("directed,first,most", [(True, None, 38), (False, None, None), (True, 0.7, None)])
def test_videos_of_a_cell(directed, first, most):
    import pyarrow as pa

    rng = random.Random(2)
    base = [rng.getrandbits(256) for _ in range(6)]
    held = {i: [rng.choice(base) ^ (1 << rng.randrange(256)) for _ in range(rng.randrange(1, 5))] for i in range(30)}
    signed = lambda v: [(v >> 64 * (3 - w) & (1 << 64) - 1) - ((v >> 64 * (3 - w) & 1 << 63) << 1) for w in range(4)]
    table = pa.table({"path": pa.array(list(held), pa.int64()), "words": pa.array([[w for f in v for w in signed(f)] for v in held.values()], pa.list_(pa.int64()))})
    apart = lambda a, b: (a ^ b).bit_count()
    want = {}
    for s, a in held.items():
        for d, b in held.items():
            value = sum(1 - min(apart(x, y) for y in b) / 256 for x in a) / len(a)
            if (s != d if directed else s < d) and value >= 0.85 and (first is None or 1 - apart(a[0], b[0]) / 256 >= first):
                want[s, d] = value
    compare = blocks.video_pairs(256, 0.85, most, first, directed, False)
    got = [r for b in compare(table, table) for r in b.to_pylist()]
    assert want and {(r["src"], r["dst"]): r["similarity"] for r in got} == want and len(got) == len(want)

import random

import pytest

from twinsift.functions import bits as B
from twinsift.operators import hamming as H
from twinsift.operators.grouping import assign_leaders
from twinsift.operators.skew import join_heads
from twinsift.plans.workspace import Workspace


def flip(rng, value, bits, n):
    for b in rng.sample(range(bits), n):
        value ^= 1 << b
    return value


def table(spark, held, bits):
    rows = spark.createDataFrame([(i, f"{v:0{bits // 4}x}") for i, v in held.items()], "node long, h string")
    return rows.select("node", *H.word_columns(B.hex_words("h"), bits))


def direct(left, right, reach):
    return {(a, b, (x ^ y).bit_count()) for a, x in left.items() for b, y in right.items() if (x ^ y).bit_count() <= reach}


@pytest.mark.parametrize("bits,reach", [(64, 12), (256, 25), (256, 0), (100, 8), (1024, 30)])
@pytest.mark.parametrize("count", [1, 10**5, 10**9])
def test_every_plan_finds_every_pair(spark, tmp_path, bits, reach, count):
    rng = random.Random(bits + reach)
    held = {i: rng.getrandbits(bits) for i in range(30)}
    for i in range(30):
        held[100 + i] = flip(rng, held[i], bits, min(reach, rng.choice([1, reach, reach - 1, reach // 2])) if reach else 0)
        held[200 + i] = flip(rng, held[i], bits, reach + 1)
    parts = H.plan_parts(bits, reach, count, count)
    assert sum(p.reach + 1 for p in parts) == reach + 1
    want = {t for t in direct(held, held, reach) if t[0] < t[1]}
    got = H.near_pairs(table(spark, held, bits), bits, reach, Workspace(spark, "t"), parts=parts).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_wider_parts_for_more_rows():
    meets = [sum(p.chance for p in H.plan_parts(256, 25, n, n)) * n for n in (10**4, 10**6, 10**8)]
    narrow = sum(p.chance for p in H.plan_parts(256, 25, 1, 1))
    assert meets[2] < narrow * 10**8 / 100 and meets == sorted(meets) and meets[2] < 100 * meets[0]
    with pytest.raises(ValueError):
        H.plan_parts(64, 64, 1, 1)


@pytest.mark.parametrize("count", [1, 10**9])
def test_hot_keys_are_split_without_loss(spark, monkeypatch, count):
    rng = random.Random(3)
    base = rng.getrandbits(256)
    # all agree in half of the bits, some are near
    held = {i: base >> 128 << 128 | rng.getrandbits(128) for i in range(120)}
    held |= {1000 + i: flip(rng, held[i], 256, 25) for i in range(0, 120, 3)}
    monkeypatch.setattr(H, "HOT_ROWS", 5)
    parts = H.plan_parts(256, 25, count, count)
    rows = table(spark, held, 256)
    hot = H.hot_keys(rows, len(held), parts, 256)
    assert hot.count() > 0
    split = H.refine_hot(H.keyed(rows, parts, 256, False), hot, parts, 256, 25)
    assert split.groupBy("key").count().agg({"count": "max"}).first()[0] < len(held)
    got = {tuple(r) for r in H.near_pairs(rows, 256, 25, Workspace(spark, "t"), parts=parts).collect()}
    assert got == {t for t in direct(held, held, 25) if t[0] < t[1]}
    some = {i: held[i] for i in list(held)[:50]}
    got = {tuple(r) for r in H.near_pairs(rows, 256, 25, Workspace(spark, "t"), probing=table(spark, some, 256), parts=parts).collect()}
    assert got == direct(some, held, 25)


def test_threshold_in_single_precision():
    assert B.most_differing(0.9, 10, True) == 1 and B.most_differing(0.7, 10) == 3 and B.most_differing(0.6, 10, True) == 4


def test_a_chain_in_path_order_takes_as_many_rounds_as_ranges(spark):
    nodes = 3_000
    edges = spark.range(nodes - 1).selectExpr("id a", "id + 1 b")
    got = {r["node"]: r["leader"] for r in assign_leaders(edges, one_task_edges=1_000).collect()}
    assert got == {i: i - 1 for i in range(1, nodes, 2)}


def test_heads_of_large_and_small_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(12_000)] + [("cold", 1), (None, 2), ("none", 3)], "k string, v int")
    heads = spark.createDataFrame([("hot", None, 12_000), ("cold", "c", 1)], "k string, head string, n long")
    got = join_heads(rows, heads, "k", "head", "n", 12_003)
    assert got.columns == ["k", "v", "head"]
    assert got.groupBy("k", "head").count().orderBy("k").collect() == [("cold", "c", 1), ("hot", None, 12_000)]

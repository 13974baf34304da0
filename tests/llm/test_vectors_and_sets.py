import itertools
import random

import numpy as np
import pytest

from twinsift.llm import knn
from twinsift.llm.hnsw import distances, near_pairs
from twinsift.llm.setjoin import record_sets, similar_classes, similar_set_pairs, similar_set_summary


def flip(rng, text, n):
    value = int(text, 16)
    for b in rng.sample(range(4 * len(text)), n):
        value ^= 1 << b
    return f"{value:0{len(text)}x}"


def vectors(rng, n):
    """Clusters of near triples; a third of all rows are copies of one triple."""
    seeds = [[f"{rng.getrandbits(256):064x}" for _ in range(3)] for _ in range(max(1, n // 6))]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, *seeds[0]))
        else:
            rows.append((i, *[flip(rng, h, rng.randrange(0, 22)) for h in rng.choice(seeds)]))
    return rows


def direct(rows, k, reach):
    held = {}
    for i, *hs in rows:
        clean = [h.strip(" ").lower() if h else "" for h in hs]
        if i is not None and all(len(h) == 64 and set(h) <= set("0123456789abcdef") for h in clean):
            held[i] = int("".join(clean), 16)
    out = set()
    for i, x in held.items():
        near = sorted(((x ^ y).bit_count(), j) for j, y in held.items() if j != i and (x ^ y).bit_count() <= reach)
        out |= {(i, j, d) for d, j in near[:k]}
    return out


@pytest.mark.parametrize("shard_rows", [40, 8_000])
def test_neighbours_reach_the_recall_asked_for(spark, shard_rows):
    rng = random.Random(1)
    rows = vectors(rng, 600)
    rows += [(rows[5][0], *[h.upper() + " " for h in rows[5][1:]]), (900, None, "a", "b"), (901, "", "", ""), (None, *rows[1][1:])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "image_id long, p string, d string, a string, vec string, node int")
    got = {tuple(r) for r in knn.similar_vectors(df, "image_id", ["p", "d", "a"], shard_rows=shard_rows).collect()}
    want = direct(rows, 5, 76)
    assert len(got & want) >= 0.9 * len(want)
    by_id = {r[0]: int("".join(h.strip().lower() for h in r[1:]), 16) for r in rows[:600]}
    assert all((by_id[i] ^ by_id[j]).bit_count() == d <= 76 for i, j, d in got)
    pairs = knn.neighbour_pairs(knn.similar_vectors(df, "image_id", ["p", "d", "a"], shard_rows=shard_rows)).collect()
    assert all(r[0] < r[1] for r in pairs) and len(set(map(tuple, pairs))) == len(pairs)


def test_copies_take_the_smallest_ids_and_empty_input_gives_nothing(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(i, h, h, h) for i in range(20, 0, -1)] * 2, "id long, p string, d string, a string")
    got = {tuple(r) for r in knn.similar_vectors(df, "id", ["p", "d", "a"]).collect()}
    assert got == {(i, j, 0) for i in range(1, 21) for j in [j for j in range(1, 21) if j != i][:5]}
    assert knn.similar_vectors(df.where("id < 0"), "id", ["p", "d", "a"]).count() == 0
    assert knn.similar_vectors(df.where("id = 1"), "id", ["p", "d", "a"]).count() == 0


def planted(rng, n, apart=40, words=12):
    """Random vectors, each with a near copy at the next position."""
    base = rng.integers(0, 2**63, (n, words)).astype(np.uint64)
    near = base.copy()
    for i in range(n):
        for b in rng.choice(64 * words, apart, replace=False):
            near[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.stack([base, near], axis=1).reshape(2 * n, words)


@pytest.mark.parametrize("ids", ["shuffled", "in the order of the vectors"])
def test_the_walk_alone_finds_pairs_in_one_shard(ids):
    rng = np.random.default_rng(2)
    rows = planted(rng, 3000)
    keys = rng.permutation(len(rows)) if ids == "shuffled" else np.arange(len(rows))
    left, right, span = near_pairs(rows, keys, 76, close_partners=False)
    found = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist())}
    assert len(found & {(2 * i, 2 * i + 1) for i in range(3000)}) >= 0.97 * 3000
    assert (span == distances(rows, left, rows, right)).all()
    assert [len(x) for x in near_pairs(rows[:1], np.arange(1), 76)] == [0, 0, 0]


@pytest.mark.parametrize("k", [5, 20, 60])
def test_the_graph_honours_k(k):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (12, 12)).astype(np.uint64)
    rows = np.repeat(centres, 100, axis=0)
    for i in range(len(rows)):
        for b in rng.choice(768, 30, replace=False):
            rows[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    left, right, span = near_pairs(rows, np.arange(len(rows)), 76, k)
    got = knn.best_per_node(np.arange(len(rows)), left, right, span, k)
    i, j = np.triu_indices(len(rows), 1)
    d = distances(rows, i, rows, j)
    want = knn.best_per_node(np.arange(len(rows)), i[d <= 76], j[d <= 76], d[d <= 76], k)
    rows_of = lambda x: set(map(tuple, x.to_numpy().tolist()))
    assert len(rows_of(got) & rows_of(want)) >= 0.95 * len(want)


def test_oversized_shards_are_routed_again_and_cut_without_loss(spark):
    rng = random.Random(5)
    # a third of all vectors are near one centre, so routing bits do not tell them apart
    centre = [f"{rng.getrandbits(256):064x}" for _ in range(3)]
    rows = [(i, *[flip(rng, h, rng.randrange(4, 10)) for h in centre]) for i in range(200)]
    rows += [(1000 + i, *[f"{rng.getrandbits(256):064x}" for _ in range(3)]) for i in range(400)]
    rows += [(5000 + r[0], *[flip(rng, h, 2) for h in r[1:]]) for r in rows[200:400]]
    df = spark.createDataFrame(rows, "image_id long, p string, d string, a string")
    got = {tuple(r) for r in knn.similar_vectors(df, "image_id", ["p", "d", "a"], shard_rows=12).collect()}
    want = direct(rows, 5, 76)
    assert len(got & want) >= 0.9 * len(want)
    work = knn.Workspace(spark, "route")
    classes = work.save(df.select(knn.F.col("image_id").alias("node"), knn.F.unhex(knn.F.concat("p", "d", "a")).alias("vec")), "classes")
    routed, _, _ = knn.route(classes, work, len(rows), 76, [(0, 256), (256, 512), (512, 768)], 12, 0.97)
    assert routed.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 3 * 12 + 12
    assert routed.select("node").distinct().count() == len(rows)


def test_more_shards_get_more_tables():
    one, many = knn.plan_tables(40_000, 76, 768, 40_000, 0.92), knn.plan_tables(400_000_000, 76, 768, 40_000, 0.92)
    assert one == (0, 1) and many[0] == 13 and many[1] > 8


def jaccard(sets):
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if 5 * len(x & y) >= 3 * len(x | y)}


def hashes(rng, n):
    return [f"{rng.getrandbits(256):064x}" for _ in range(n)]


def test_set_pairs_equal_brute_force_with_hot_elements(spark, monkeypatch):
    rng = random.Random(3)
    hot = hashes(rng, 6)
    rare = hashes(rng, 400)
    sets = {}
    for i in range(400):
        kind = i % 4
        if kind == 0:  # made of frequent elements only
            sets[i] = set(rng.sample(hot, rng.randrange(3, 7)))
        elif kind == 1 or len(sets) < 5:
            sets[i] = set(rng.sample(rare, rng.randrange(3, 12))) | set(rng.sample(hot, 2))
        else:  # a near copy
            s = set(sets[rng.choice(list(sets))])
            for _ in range(rng.randrange(3)):
                s ^= {rng.choice(rare)}
            sets[i] = s if len(s) > 2 else set(rng.sample(rare, 4))
    rows = [(i, [h.upper() + " " if rng.random() < 0.3 else h for h in s] + ["", None, "zz"] + list(s)[:1]) for i, s in sets.items()]
    rows += [(i, list(s)[::-1]) for i, s in list(sets.items())[:50]] + [(1000, None), (1001, []), (1002, hot[:2]), (None, hot)]
    df = spark.createDataFrame(rows, "id long, f array<string>")
    records = record_sets(df, "id", "f")
    assert {r["id"] for r in records.collect()} == set(sets)
    want = jaccard(sets)
    got = [tuple(r) for r in similar_set_pairs(records).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the same in small blocks
    import twinsift.llm.setjoin as module

    monkeypatch.setattr(module, "CELL_BLOCK", 7)
    assert {tuple(r) for r in similar_set_pairs(records).collect()} == want
    links = {r["id"]: (r["class_id"], r["links"]) for r in similar_set_summary(records).collect()}
    for i, s in sets.items():
        assert links[i] == (min(j for j, t in sets.items() if t == s), sum(i in p for p in want))


def test_a_third_of_equal_sets_stays_one_class(spark):
    rng = random.Random(4)
    s = hashes(rng, 5)
    df = spark.createDataFrame([(i, s) for i in range(300)] + [(i, hashes(rng, 4)) for i in range(300, 900)], "id long, f array<string>")
    pairs, members = similar_classes(record_sets(df, "id", "f"))
    assert pairs.count() == 0 and members.count() == 900
    assert members.select("node").distinct().count() == 601
    assert similar_set_pairs(record_sets(df.where("id < 0"), "id", "f")).count() == 0


def test_two_frames_in_a_tenth_of_the_records_make_no_cell_of_them(spark, monkeypatch):
    import twinsift.llm.setjoin as module

    rng = random.Random(6)
    hot = hashes(rng, 2)
    sets = {i: set(hashes(rng, 1 + i % 9)) | (set(hot) if i % 10 == 0 else set(hashes(rng, 2))) for i in range(1500)}
    sets |= {5000 + i: sets[i] | set(hashes(rng, 1)) for i in range(0, 1500, 50)}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, f array<string>")
    seen = []
    real = module.witness_rows

    def spy(*args):
        rows = real(*args)
        seen.append(rows.groupBy("key").count().agg({"count": "max"}).first()[0])
        return rows

    monkeypatch.setattr(module, "witness_rows", spy)
    pairs = {tuple(r) for r in similar_set_pairs(record_sets(df, "id", "f")).collect()}
    assert pairs == jaccard(sets) and pairs and max(seen) < 50


def test_homes_and_visitors_of_a_cell(spark):
    rng = random.Random(7)
    base = hashes(rng, 12)
    extra = hashes(rng, 40)
    # everything from copies with one element changed to sets at the edge of the threshold
    sets = {i: (set(base) - set(rng.sample(base, rng.randrange(4)))) | set(rng.sample(extra, rng.randrange(5))) for i in range(120)}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, f array<string>")
    assert {tuple(r) for r in similar_set_pairs(record_sets(df, "id", "f")).collect()} == jaccard(sets)

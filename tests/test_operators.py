import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from twinsift.operators import report as R
from twinsift.operators import similarity as S
from twinsift.operators.grouping import assign_leaders, greedy_groups
from twinsift.operators.groups import exact_groups, image_groups, near_image_groups, numbered_groups, remaining_images, video_groups
from twinsift.operators.skew import compress, top_record, weighted_percentiles, weighted_summary
from twinsift.schema import IMAGE_ROW, VIDEO_ROW

KINDS = ("phash", "ahash", "dhash", "whash")


def near(rng, text, flips):
    value = int(text, 16)
    for b in rng.sample(range(4 * len(text)), flips):
        value ^= 1 << b
    return f"{value:0{len(text)}x}"


def images(rng, n, digits=64):
    """Clusters of near images, exact copies, and rows that lack hashes."""
    seeds = [{k: f"{rng.getrandbits(4 * digits):0{digits}x}" for k in KINDS} for _ in range(n // 5)]
    rows = []
    for i in range(n):
        s = rng.choice(seeds)
        row = {k: near(rng, v, rng.choice([0, 0, 5, 20, 30])) for k, v in s.items()}
        if rng.random() < 0.2:
            row[rng.choice(KINDS[1:])] = None
        rows.append({"path": f"/p/{i:03d}", "width": i, "height": 2, "file_size": rng.choice([0, 10, 20, 10**10]), "format": "PNG", "mode": "RGB", **row})
    return rows


def frame(spark, rows):
    names = [c.split()[0] for c in IMAGE_ROW.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], IMAGE_ROW)


def sim(a, b, kinds=KINDS):
    parts = [1 - (int(a[k], 16) ^ int(b[k], 16)).bit_count() / (4 * len(a[k])) for k in kinds if a[k] and b[k] and len(a[k]) == len(b[k])]
    return sum(parts) / len(parts) if parts else 0.0


def first_come(paths, measure, threshold):
    """Leaders by direct comparison in path order."""
    taken, out = set(), []
    for i, p in enumerate(paths):
        if p in taken:
            continue
        group = [(p, p, 1.0)] + [(p, q, measure(p, q)) for q in paths[i + 1 :] if q not in taken and measure(p, q) >= threshold]
        if len(group) > 1:
            out += group
            taken |= {q for _, q, _ in group}
    return out


def rows_of(df):
    return sorted((r["leader"], r["path"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["combined", "phash", "whash"])
def test_near_groups_equal_direct_comparison(spark, kind):
    rows = images(random.Random(4), 70)
    by = {r["path"]: r for r in rows}
    kinds = KINDS if kind == "combined" else (kind,)
    want = sorted((a, b, round(s, 9)) for a, b, s in first_come(sorted(by), lambda p, q: sim(by[p], by[q], kinds), 0.9))
    assert rows_of(near_image_groups(frame(spark, rows), 0.9, kind)) == want


def test_pairs_of_mixed_sizes_and_unknown_kind(spark):
    rng = random.Random(5)
    rows = images(rng, 30) + [r | {"path": "/q/" + r["path"][3:]} for r in images(rng, 30, 16)]
    found = {(r[0], r[1]) for r in S.image_pairs(frame(spark, rows), 0.9).collect()}
    reps = {tuple(r[k] for k in KINDS): r for r in reversed(sorted(rows, key=lambda r: r["path"]))}.values()
    want = {(a["path"], b["path"]) for a, b in itertools.permutations(reps, 2) if a["path"] < b["path"] and sim(a, b) >= 0.9}
    assert found == want
    assert S.image_pairs(frame(spark, rows), 0.9, "other").count() == 0
    with pytest.raises(ValueError):
        S.image_pairs(frame(spark, rows), 0.0)


@pytest.mark.parametrize("bits,threshold", [(64, 0.8), (256, 0.9), (256, 1.0), (100, 0.92)])
def test_banding_finds_every_pair(spark, bits, threshold):
    rng = random.Random(bits)
    base = [f"{rng.getrandbits(bits):0{bits // 4}x}" for _ in range(20)]
    hashes = base + [near(rng, h, k) for h in base for k in (1, 8, 12, 25)] + [None, "", "zz", base[0].upper()]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h string")
    got = {(r[0], r[1]) for r in S.hash_pairs(rows, "id", "h", threshold, bits).collect()}
    ids = {}
    for i, h in enumerate(hashes):
        if h and h != "zz":
            ids.setdefault(h.lower(), i)
    want = {tuple(sorted((i, j))) for (g, i), (h, j) in itertools.combinations(ids.items(), 2) if 1 - (int(g, 16) ^ int(h, 16)).bit_count() / bits >= threshold}
    assert got == want


def test_empty_inputs(spark):
    none = frame(spark, [])
    assert near_image_groups(none, 0.9).count() == 0
    assert image_groups(none).count() == 0
    assert numbered_groups(image_groups(none), none).count() == 0
    assert R.totals(R.group_savings(numbered_groups(image_groups(none), none), none)).first()[:] == (0, 0, 0)
    assert video_groups(spark.createDataFrame([], VIDEO_ROW)).count() == 0


def test_exact_groups_take_all_copies_first(spark):
    base = {k: "0" * 64 for k in KINDS}
    rows = [{"path": "/a", **base}, {"path": "/b", **base}, {"path": "/c", **base, "phash": "0" * 63 + "1"}, {"path": "/d", **base, "phash": None}, {"path": "/e", **base, "phash": "0" * 63 + "3"}]
    df = frame(spark, rows)
    assert rows_of(exact_groups(df)) == [("/a", "/a", 1.0), ("/a", "/b", 1.0)]
    assert sorted(r[0] for r in remaining_images(df).select("path").collect()) == ["/c", "/d", "/e"]
    strict = image_groups(df, 0.9)
    assert sorted((r["phase"], r["leader"], r["path"]) for r in strict.collect()) == [(0, "/a", "/a"), (0, "/a", "/b"), (1, "/c", "/c"), (1, "/c", "/e")]
    # few rows without acceleration: no exact pass, so all are one group
    plain = image_groups(df, 0.9, mode="compat", accelerated=False)
    assert sorted(r["path"] for r in plain.collect()) == ["/a", "/b", "/c", "/e"]


def test_compatible_mode_looks_at_one_hash_beyond_fifty_rows(spark):
    rng = random.Random(9)
    rows = [{"path": f"/x/{i:03d}", **{k: f"{rng.getrandbits(256):064x}" for k in KINDS}} for i in range(60)]
    twin = rows[0] | {"path": "/x/999", "phash": near(rng, rows[0]["phash"], 4)} | {k: f"{rng.getrandbits(256):064x}" for k in KINDS[1:]}
    df = frame(spark, [*rows, twin])
    assert image_groups(df, 0.9, mode="compat").count() == 2
    assert image_groups(df, 0.9, mode="strict").count() == 0
    assert image_groups(df.where("path > '/x/030' or path = '/x/000'"), 0.9, mode="compat").count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_first_come_grouping_in_one_task_and_in_rounds(spark, limit):
    rng = random.Random(6)
    for n in (5, 30):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)] + [(None, 1), (2, 2)]
        friends = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
        want = sorted((a, b) for a, b, _ in first_come(list(range(n)), lambda p, q: float(frozenset((p, q)) in friends), 1.0) if a != b)
        got = assign_leaders(spark.createDataFrame(edges, "a long, b long"), limit)
        assert sorted((r["leader"], r["node"]) for r in got.collect()) == want


def test_chain_depends_on_order_and_members_show_similarity_to_the_leader(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("c", "b", 0.8), ("b", "a", 0.95)], "src string, dst string, similarity double")
    assert rows_of(greedy_groups(edges)) == [("a", "a", 1.0), ("a", "b", 0.95)]


def videos(spark, held):
    return spark.createDataFrame([(p, 1.0, 1.0, 1, 1, 1, 5, f, None) for p, f in held], VIDEO_ROW)


def test_video_similarity_strict_compatible_and_not_symmetric(spark):
    rng = random.Random(7)
    a = [f"{rng.getrandbits(256):064x}" for _ in range(4)]
    b = [near(rng, h, 10) for h in a] + [f"{rng.getrandbits(256):064x}" for _ in range(4)]
    c = [f"{rng.getrandbits(256):064x}" for _ in range(5)]
    df = videos(spark, [("/a", a), ("/b", b), ("/c", c), ("/d", a), ("/e", []), ("/f", None), ("/g", ["bad"])])

    def measure(x, y, square=False):
        best = [max(1 - (int(g, 16) ^ int(h, 16)).bit_count() / (256**2 if square else 256) for h in y) for g in x]
        return sum(best) / len(best)

    pairs = S.video_pairs(S.video_classes(df), 0.85)
    assert [(r[0], r[1], round(r[2], 9)) for r in pairs.collect()] == [("/a", "/b", round(measure(a, b), 9))]
    assert measure(b, a) < 0.85
    compat = {(r[0], r[1]): round(r[2], 9) for r in S.video_pairs(S.video_classes(df), 0.85, compat=True).collect()}
    assert compat == {(p, q): round(measure(x, y, True), 9) for (p, x), (q, y) in itertools.combinations([("/a", a), ("/b", b), ("/c", c)], 2)}
    assert S.video_pairs(S.video_classes(df), 0.85, compat=True, prefilter=True).count() == 1
    assert {r["path"] for r in video_groups(df).collect()} == {"/a", "/b", "/d"}


def test_matrix_and_rectangle(spark):
    rows = spark.createDataFrame([(1, "ff"), (2, "0f"), (3, "zz")], "id long, h string")
    got = {(r[0], r[1]): r[2] for r in S.similarity_matrix(rows, rows, "id", "h", 8).collect()}
    assert got[1, 1] == 1.0 and got[1, 2] == 0.5 and got[1, 3] == 0.0 and len(got) == 9
    pairs = S.hamming_rectangle(rows, rows.withColumnRenamed("id", "j").withColumnRenamed("h", "g"), "id", "h", "j", "g")
    assert sorted(r[:] for r in pairs.collect()) == [(1, 1, 0), (1, 2, 4), (2, 1, 4), (2, 2, 0)]


def test_ranks_numbers_and_savings(spark):
    rows = [{"path": p, "file_size": s, "phash": h, "format": f, "width": 1, "height": 1} for p, s, h, f in [("/b", 5, "aa", "PNG"), ("/a", 9, "aa", ""), ("/c", 1, "bb", None), ("/d", 1, "bb", "X"), ("/e", 1, "cc", "X")]]
    df = frame(spark, rows)
    numbered = numbered_groups(exact_groups(df), df)
    assert sorted((r["group_id"], r["rank"], r["path"]) for r in numbered.collect()) == [(1, 1, "/a"), (1, 2, "/b"), (2, 1, "/c"), (2, 2, "/d")]
    savings = R.group_savings(numbered.unionByName(numbered.limit(1).withColumn("path", F.lit("/gone"))), df)
    assert R.totals(savings).first()["potential_savings_bytes"] == 6
    assert {r["format"] for r in R.group_report(numbered, df).collect()} == {"PNG", "Unknown", "X"}


def test_hot_key_results_equal_direct_ones(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(30)}", rng.choice([None, -5, 0, 7, rng.randrange(10**6), 2**40]), i % 700, "x") for i in range(2000)] + [(None, 1, 1, "x"), ("only-null", None, 5, "x")]
    df = spark.createDataFrame(rows, "k string, v long, id long, value string")
    weighted = compress(df, ["k"], F.col("v"))
    summary = {r["k"]: r for r in weighted_summary(weighted, ["k"]).collect()}
    quantiles = {(r["k"], r["share"]): r["value"] for r in weighted_percentiles(weighted, ["k"], [0.0, 0.5, 0.9, 1.0]).collect()}
    by = {}
    for k, v, _, _ in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        assert (summary[k]["records"], summary[k]["n_values"]) == (len(vs), len(set(known)))
        if not known:
            assert summary[k]["mode"] is None
            continue
        assert summary[k]["mode"] == min(statistics.multimode(known))
        if k is not None:
            for share in (0.0, 0.5, 0.9, 1.0):
                assert quantiles[k, share] == known[max(1, -(-round(len(known) * share, 6) // 1).__int__()) - 1]
    best = {}
    for k, v, i, _ in rows:
        if k is not None:
            best.setdefault(k, {})[i] = max(best.get(k, {}).get(i, 0), v or 0)
    want = {k: min(ids, key=lambda i: (-ids[i], i)) for k, ids in best.items() if len(ids) > 1}
    assert {r["k"]: r["top_id"] for r in top_record(df, ["k"], "id", F.col("v")).collect()} == want

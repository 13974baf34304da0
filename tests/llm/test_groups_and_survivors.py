import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest

from twinsift.llm import incremental as inc
from twinsift.llm.components import component_roots, counting_edges, forest, linked_groups
from twinsift.llm.survivor import SURVIVORS, VOTES, surviving_values, survivors_by_group, unpivot_media


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("part_edges", [20, 100_000])
def test_groups_of_chains_hubs_and_cycles(spark, part_edges):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    edges += [("hub", f"leaf{i}") for i in range(150)]
    edges += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    edges += [(b, a) for a, b in edges[:30]] + edges[:10]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b, 0.9, "x") for a, b in edges] + [(None, "z", 0.9, "x"), ("z", "z", 0.9, "x")], "src string, dst string, similarity double, path string")
    got = {r["path"]: r["group_key"] for r in linked_groups(df, part_edges=part_edges).collect()}
    assert got == components([e for e in edges if e[0] != e[1]])


def test_weak_edges_do_not_count_and_no_edges_give_nothing(spark):
    rows = [("a", "b", 0.85), ("b", "c", 0.8499), ("c", "d", None), ("d", "e", float("nan")), ("é", "z", 1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, similarity double")
    got = {r["path"]: r["group_key"] for r in linked_groups(counting_edges(df)).collect()}
    assert got == {"a": "a", "b": "a", "é": "z", "z": "z"}
    assert linked_groups(df.limit(0)).count() == 0
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_has_one_root_per_tree():
    node, root = forest(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert dict(zip(node.tolist(), root.tolist())) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_survivors_and_their_ties(spark):
    t = [dt.datetime(2023, 1, d) for d in range(1, 6)]
    image = "path string, width int, height int, file_size long, scanned_at timestamp, group_id int, value string"
    video = "path string, width int, height int, file_size long, scanned_at timestamp, duration double"
    images = spark.createDataFrame(
        [
            ("/b", 10, 10, 5, t[0], 7, "x"), ("/a", 20, 5, 6, t[0], 7, "x"), ("/c", 10, 10, 7, None, 7, "x"), ("/c", None, 10, -1, t[4], 7, "x"),
            ("/c", 0, 10, 0, t[4], 7, "x"), ("/d", 1, 1, 9, None, 7, "x"), ("/d", 1, 1, 9, None, 7, "x"), (None, 99, 99, 99, t[4], 7, "x"),
        ],
        image,
    )
    videos = spark.createDataFrame([("/v", 1, 1, 1, t[0], float("inf")), ("/v", 1, 1, 1, t[1], float("nan")), ("/w", 1, 1, 1, t[1], 3.5), ("/v", 1, 1, 1, t[1], 3.5), ("/v", 1, 1, 2, t[0], -1.0)], video)
    members = spark.createDataFrame([(1, p, "z") for p in ("/a", "/b", "/c", "/a", None, "/gone")] + [(2, "/d", "z"), (3, "/v", "z"), (3, "/w", "z"), (None, "/a", "z")], "group_id int, path string, field string")
    fields = unpivot_media(images, videos)
    got = {(r["group_id"], r["field"]): (r["path"], r["value"]) for r in surviving_values(members, fields, SURVIVORS).collect()}
    assert got == {
        (1, "resolution"): ("/a", 100.0), (1, "file_size"): ("/a", 6.0), (2, "resolution"): ("/d", 1.0), (2, "file_size"): ("/d", 9.0),
        (3, "resolution"): ("/v", 1.0), (3, "file_size"): ("/v", 1.0), (3, "duration"): ("/v", 3.5),
    }
    golden = {r["group_id"]: r.asDict() for r in survivors_by_group(surviving_values(members, fields, VOTES), ["resolution", "file_size", "duration"]).collect()}
    assert golden[1]["resolution"] == 100.0 and golden[1]["duration"] is None and golden[3]["duration"] == 3.5
    assert surviving_values(members.limit(0), fields, SURVIVORS).count() == 0


def test_votes_prefer_trusted_and_recent_values(spark):
    t = lambda y: dt.datetime(y, 6, 1)
    rows = [("/a", "images", "file_size", 1.0, t(2015)), ("/b", "images", "file_size", 1.0, t(2015)), ("/c", "images", "file_size", 2.0, t(2023)), ("/d", "videos", "file_size", 3.0, t(2023))]
    fields = spark.createDataFrame(rows, "path string, source string, field string, value double, seen timestamp")
    members = spark.createDataFrame([(1, p) for p in "/a /b /c /d".split()], "group_id int, path string")
    for trust, want in (({}, 3.0), ({"videos": 0.5}, 2.0)):
        got = surviving_values(members, fields, VOTES, trust=trust).collect()
        assert [r["value"] for r in got] == [want]
    # without decay two votes beat one
    assert surviving_values(members, fields, VOTES, half_life_days=1e9).first()["value"] == 1.0


def near_hash(rng, text, n):
    value = int(text, 16)
    for b in rng.sample(range(256), n):
        value ^= 1 << b
    return f"{value:064x}"


def stream(rng, n):
    """Image and video rows of five batches with near copies, exact copies and redeliveries."""
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(n // 4)]
    images, videos = [], []
    for i in range(n):
        h = hashes[0] if i % 3 == 0 else near_hash(rng, rng.choice(hashes), rng.choice([0, 3, 12, 13, 20]))
        images.append((100 + i, h if rng.random() < 0.9 else rng.choice([None, "", "bad", h.upper() + " "]), rng.randrange(1, 6), "PNG", i % 5, "k"))
        s = rng.sample(hashes[:30], rng.randrange(0, 6)) if i % 2 or not videos else list(rng.choice(videos)[1] or [])[: rng.randrange(1, 9)]
        videos.append((5000 + i, s if rng.random() < 0.95 else None, rng.randrange(1, 6), i % 5))
    images += [(i, h, b + 1, f, s, k) for i, h, b, f, s, k in images[:40]]
    known = [(1, "image", hashes[1], None), (2, "image", None, None), (3, "video", None, hashes[:5]), (4, "video", None, None)]
    return images, videos, known


def clean(h):
    h = (h or "").strip(" ").lower()
    return h if len(h) == 64 and set(h) <= set("0123456789abcdef") else None


def one_by_one(images, videos, known):
    cases = set()
    accepted = [int(clean(k[2]), 16) for k in known if clean(k[2])]
    first = {}
    for i, h, b, *_ in images:
        old = first.get(i, (9, None))
        first[i] = min(old[0], b), max(filter(None, [old[1], clean(h)]), default=None)
    for i, (b, h) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        if h:
            if any((int(h, 16) ^ a).bit_count() <= 25 for a in accepted):
                cases.add(("image", i))
            else:
                accepted.append(int(h, 16))
    sets = [frozenset(filter(None, map(clean, k[3] or []))) for k in known]
    sets = [s for s in sets if s]
    for i, f, b, _ in sorted(videos, key=lambda v: (v[2], v[0])):
        s = frozenset(filter(None, map(clean, f or [])))
        if s:
            if any(Fraction(len(s & t), len(s | t)) >= Fraction(3, 5) for t in sets):
                cases.add(("video", i))
            else:
                sets.append(s)
    return cases


@pytest.mark.parametrize("outgrown, edges, share", [(0.2, 10**6, 0), (8, 0, 4)])
def test_batches_equal_arrivals_one_by_one(spark, monkeypatch, outgrown, edges, share):
    images, videos, known = stream(random.Random(2), 240)
    monkeypatch.setattr(inc, "STEP_SHARE", share)
    monkeypatch.setattr(inc, "STEP_ROWS", 0)
    monkeypatch.setattr(inc, "OUTGROWN", outgrown)
    monkeypatch.setattr(inc, "ONE_TASK_EDGES", edges)
    got = inc.duplicates_of_history(
        spark.createDataFrame(images, "image_id long, phash string, batch_no int, format string, file_size long, key string"),
        spark.createDataFrame(videos, "video_id long, frame_hashes array<string>, batch_no int, file_size long"),
        spark.createDataFrame(known, "known_id long, media string, phash string, frame_hashes array<string>"),
    ).collect()
    rows = [(r["media"], r["record_id"]) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == one_by_one(images, videos, known)
    assert all(r["keeper"] is not None and r["keeper"] != r["record_id"] for r in got)


@pytest.mark.parametrize("expected", [10, 10**7, 10**9])
def test_wide_parts_are_exact_too(spark, tmp_path, expected):
    rng = random.Random(3)
    base = [f"{rng.getrandbits(256):064x}" for _ in range(40)]
    rows = [(i, 1, h) for i, h in enumerate(base)] + [(100 + i, 2, near_hash(rng, h, 25 if i % 2 else 26)) for i, h in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, batch_no int, h string").select("id", "batch_no", *inc.word_columns(inc.F.col("h")), inc.F.lit("x").alias("format"), inc.F.lit(1).cast("long").alias("bytes"))
    history = inc.History.create(spark, str(tmp_path / "h"), "image", expected=expected, batch=40)
    done = inc.deduplicate_batches(history, df, None)
    assert {r["id"]: r["keeper"] for r in done.where("keeper is not null").collect()} == {100 + i: i for i in range(40) if i % 2}


@pytest.mark.parametrize("kind", ["image", "video"])
def test_a_history_goes_on_in_another_session(spark, tmp_path, monkeypatch, kind):
    images, videos, known = stream(random.Random(4), 160)
    monkeypatch.setattr(inc, "OUTGROWN", 3)
    images = spark.createDataFrame(images, "image_id long, phash string, batch_no int, format string, file_size long, key string")
    videos = spark.createDataFrame(videos, "video_id long, frame_hashes array<string>, batch_no int, file_size long")
    known = spark.createDataFrame(known, "known_id long, media string, phash string, frame_hashes array<string>")
    items = inc.image_items(images) if kind == "image" else inc.video_items(videos)
    accepted = inc.known_items(known, kind)
    whole = inc.duplicates_of_history(images, videos, known).where(inc.F.col("media") == kind)
    want = {r["record_id"] for r in whole.collect()}
    path = str(tmp_path / "history")
    inc.History.create(spark, path, kind, expected=10, batch=10, clusters=True).accept(accepted)
    got, generations = set(), set()
    for batch in range(1, 6):
        session = spark.newSession()  # nothing but the folder is handed on
        history = inc.History.open(session, path)
        rows = session.createDataFrame(items.where(inc.F.col("batch_no") == batch).drop("batch_no").collect(), items.drop("batch_no").schema)
        if batch == 3:
            # a step that ends before it is committed leaves nothing behind
            lost = inc.History.open(session, path)
            monkeypatch.setattr(lost, "finish", lambda: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                lost.ingest(rows)
            history = inc.History.open(session, path)
        found = history.ingest(rows).collect()
        got |= {r["id"] for r in found if r["keeper"] is not None}
        assert {r["id"] for r in found} == {r["id"] for r in rows.collect()}
        # what came before is not decided again
        assert history.ingest(rows).count() == 0
        generations.add(history.state["generation"])
    assert got == want and len(generations) > 1


def test_weights_are_learned_without_labels():
    rng = np.random.default_rng(1)
    match = rng.random(5000) < 0.4
    gap = np.where(match, rng.choice(5, 5000, p=[0.5, 0.3, 0.1, 0.05, 0.05]), rng.choice(5, 5000, p=[0.02, 0.03, 0.05, 0.2, 0.7]))
    form = np.where(match, rng.choice(3, 5000, p=[0.9, 0.05, 0.05]), rng.choice(3, 5000, p=[0.3, 0.1, 0.6]))
    size = rng.choice(3, 5000, p=[0.3, 0.3, 0.4])
    gaps, forms, sizes = inc.learn_weights(np.stack([gap, form, size], 1), np.ones(5000), (5, 3, 3))
    assert gaps == sorted(gaps, reverse=True) and gaps[0] > 2 > -2 > gaps[-1]
    assert forms[0] > 0.8 and forms[2] < -1.5 and max(map(abs, sizes)) < 0.5


def test_no_arrivals(spark):
    empty = inc.duplicates_of_history(
        spark.createDataFrame([], "image_id long, phash string, batch_no int, format string, file_size long"),
        spark.createDataFrame([], "video_id long, frame_hashes array<string>, batch_no int, file_size long"),
        spark.createDataFrame([], "known_id long, media string, phash string, frame_hashes array<string>"),
    )
    assert empty.count() == 0


def test_the_log_of_clusters_grows_only_where_linked(spark):
    work = inc.Workspace(spark, "t")
    log = spark.createDataFrame([(2, 1), (8, 7)], "item long, parent long")
    links = spark.createDataFrame([(3, 2), (3, 9), (20, 21), (1, 2)], "a long, b long")
    fresh = inc.merged_roots(links, log, work, "one")
    assert sorted(map(tuple, fresh.collect())) == [(3, 1), (9, 1), (21, 20)]
    log = log.unionByName(fresh)
    log = log.unionByName(inc.merged_roots(spark.createDataFrame([(8, 9)], "a long, b long"), log, work, "two"))
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20, 21, 30)], "node long")
    got = {r["node"]: r["root"] for r in inc.find_roots(nodes, log, work, "all").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 30: 30}


def test_steps_take_batches_in_order(monkeypatch):
    monkeypatch.setattr(inc, "STEP_ROWS", 10)
    assert inc.plan_steps([(1, 50), (2, 1)], 3) == [1]
    assert inc.plan_steps([(1, 4), (2, 6), (3, 1)], 3) == [1, 2]
    assert inc.plan_steps([(1, 4), (2, 6), (3, 1)], 10) == [1, 2, 3]
    assert inc.plan_steps([(7, 1)], 0) == [7]

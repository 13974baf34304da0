import random
from fractions import Fraction

import pytest

from twinsift.llm import incremental as inc

IMAGES = "image_id long, phash string, batch_no int, format string, file_size long"
VIDEOS = "video_id long, frame_hashes array<string>, batch_no int, file_size long"
KNOWN = "known_id long, media string, phash string, frame_hashes array<string>"


def flipped(text, bits):
    value = int(text, 16)
    for b in bits:
        value ^= 1 << b
    return f"{value:064x}"


def parts(rows):
    held = {}
    for media, record, cluster in rows:
        held.setdefault((media, cluster), set()).add(record)
    return sorted(map(sorted, held.values()))


def one_by_one(media, accepted, arrivals, near):
    """Clusters of duplicates and the items accepted before them that are near."""
    accepted, root = dict(accepted), {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for record, value in arrivals:
        hits = [k for k, v in accepted.items() if near(v, value)]
        for k in hits:
            root[find(k)] = find(record)
        if not hits:
            accepted[record] = value
    return parts([(media, x, find(x)) for x in list(root)])


def clusters(spark, images, videos=(), known=()):
    rows = inc.clusters_of_history(spark.createDataFrame(list(images), IMAGES), spark.createDataFrame(list(videos), VIDEOS), spark.createDataFrame(list(known), KNOWN)).collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("share", [0, 100])
def test_a_duplicate_joins_accepted_items_of_earlier_batches(spark, monkeypatch, share):
    monkeypatch.setattr(inc, "STEP_SHARE", share)
    monkeypatch.setattr(inc, "STEP_ROWS", 0)
    a = f"{random.Random(8).getrandbits(256):064x}"
    b, both = flipped(a, range(40)), flipped(a, range(20))
    c, two = flipped(b, range(100, 140)), flipped(b, range(100, 120))
    images = [(100, a, 1, "x", 1), (101, b, 2, "x", 1), (102, c, 2, "x", 1), (103, both, 3, "x", 1)]
    assert parts(clusters(spark, images)) == [[100, 101, 103]]
    # a later duplicate joins the cluster to one more item; 105 and 107 are copies, between which 106 near them is accepted
    d = f"{random.Random(9).getrandbits(256):064x}"
    e, f = flipped(d, range(20)), flipped(d, range(5, 35))
    images += [(110, two, 4, "x", 1), (104, d, 4, "x", 1), (105, e, 5, "x", 1), (106, f, 6, "x", 1), (107, e, 7, "x", 1)]
    rows = clusters(spark, images)
    assert parts(rows) == [[100, 101, 102, 103, 110], [104, 105, 106, 107]]
    assert {r[2] for r in rows} == {100, 104}


@pytest.mark.parametrize("outgrown, share", [(0.2, 0), (8, 4)])
def test_clusters_equal_arrivals_one_by_one(spark, monkeypatch, outgrown, share):
    monkeypatch.setattr(inc, "OUTGROWN", outgrown)
    monkeypatch.setattr(inc, "STEP_SHARE", share)
    monkeypatch.setattr(inc, "STEP_ROWS", 0)
    rng = random.Random(4)
    centre = f"{rng.getrandbits(256):064x}"
    images = [(100 + i, flipped(centre, rng.sample(range(64), rng.randrange(12, 40))), rng.randrange(6), "x", 1) for i in range(90)]
    images += [(300 + i, h, rng.randrange(6), "x", 1) for i, (_, h, *_) in enumerate(rng.sample(images, 30))]
    codes = [f"{rng.getrandbits(256):064x}" for _ in range(9)]
    videos = [(5000 + i, rng.sample(codes, rng.randrange(1, 7)), rng.randrange(6), 1) for i in range(80)]
    known = [(1, "image", flipped(centre, range(30)), None), (2, "video", None, codes[:4])]
    order = lambda rows: [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    want = one_by_one("image", [(1, known[0][2])], order(images), lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count() <= 25)
    want += one_by_one("video", [(2, frozenset(codes[:4]))], [(i, frozenset(s)) for i, s in order(videos)], lambda x, y: Fraction(len(x & y), len(x | y)) >= Fraction(3, 5))
    assert parts(clusters(spark, images, videos, known)) == sorted(want)

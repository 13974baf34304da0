import random

import pytest

from twinsift.plans import queries as core

VIDEOS = "video_id long, path string, frame_hashes array<string>, file_size long, width int, height int, duration double, scanned_at timestamp, ingested_at timestamp"


def flipped(rng, text, n):
    value = int(text, 16)
    for b in rng.sample(range(256), n):
        value ^= 1 << b
    return f"{value:064x}"


def measure(x, y, square=False):
    best = [max(1 - (int(g, 16) ^ int(h, 16)).bit_count() / (256**2 if square else 256) for h in y) for g in x]
    return sum(best) / len(best)


def written(spark, folder, held):
    df = spark.createDataFrame([(i, f"/{i:06d}", f, 1, 1, 1, 1.0, None, None) for i, f in held.items()], VIDEOS)
    df.write.parquet(f"{folder}/videos.parquet")
    return str(folder)


@pytest.mark.parametrize("name, threshold, square", [("video_queries_strict", 0.85, False), ("video_queries_compat", 0.9965, True), ("video_queries_prefilter", 0.9965, True)])
def test_every_query_id_meets_every_other_row(spark, tmp_path, name, threshold, square):
    rng = random.Random(5)
    a = [f"{rng.getrandbits(256):064x}" for _ in range(3)]
    b, c, d = [flipped(rng, h, 9) for h in a], [flipped(rng, h, 11) for h in a[:2]], [f"{rng.getrandbits(256):064x}" for _ in range(3)]
    # 20 and 40 are queries by a copy of smaller id, 60 has partners of smaller id only, 81 is no query
    held = {3: a, 20: a, 7: d, 40: d, 11: b, 60: c, 81: [a[0], d[0]], 100: [], 120: None}
    folder = written(spark, tmp_path, held)
    of = {r["video_id"]: r["class_id"] for r in core.video_class_members(spark, folder).collect()}
    assert of == {3: 3, 20: 3, 7: 7, 40: 7, 11: 11, 60: 60, 81: 81}
    want = {}
    for i in (20, 40, 60):
        for j in of:
            first = 1 - (int(held[i][0], 16) ^ int(held[j][0], 16)).bit_count() / 256
            if of[i] != of[j] and (value := measure(held[i], held[j], square)) >= threshold and ("prefilter" not in name or first >= threshold - 0.2):
                want[of[i], of[j]] = round(value, 6)
    assert (60, 3) in want
    got = core.queries()[name](spark, folder).collect()
    assert {(r["src"], r["dst"]): r["similarity"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name, threshold, square", [("video_similarity_strict", 0.85, False), ("video_similarity_compat", 0.9965, True), ("video_prefilter_refine", 0.9965, True)])
def test_long_videos_are_queries_and_partners(spark, tmp_path, name, threshold, square):
    rng = random.Random(6)
    a = [f"{rng.getrandbits(256):064x}" for _ in range(2)]
    long = [flipped(rng, a[i % 2], 5) for i in range(1001)]
    longer = [flipped(rng, a[i % 2], 5) for i in range(1200)]
    folder = written(spark, tmp_path, {20: a, 40: long, 41: longer})
    got = {(r["src"], r["dst"]): r["similarity"] for r in core.queries()[name](spark, folder).collect()}
    want = {(20, 40): measure(a, long, square), (20, 41): measure(a, longer, square), (40, 41): measure(long, longer, square)}
    assert min(want.values()) >= threshold and got == {k: round(v, 6) for k, v in want.items()}

import random

from twinsift.plans import queries as core

IMAGES = "image_id long, path string, phash string, ahash string, dhash string, whash string, file_size long, width int, height int, scanned_at timestamp, ingested_at timestamp"


def test_links_of_copies_follow_from_their_class(spark, tmp_path):
    rng = random.Random(2)
    p, q = (f"{rng.getrandbits(256):064x}" for _ in range(2))
    near = f"{int(p, 16) ^ 7:064x}"
    held = {"/a": (p, q, None, q), "/b": (p.upper(), q, None, q), "/c": (near, q, None, q), "/d": (p, q, q, q), "/e": (near, q, "bad", q), "/f": (None, q, q, q)}
    rows = [(i, path, *hashes, 1, 1, 1, None, None) for i, (path, hashes) in enumerate(held.items())]
    spark.createDataFrame(rows, IMAGES).write.parquet(f"{tmp_path}/images.parquet")
    of = dict(map(tuple, core.queries()["image_class_members"](spark, str(tmp_path)).collect()))
    assert of == {"/a": "/a", "/b": "/a", "/c": "/c", "/d": "/d", "/e": "/c"}
    pairs = {(r["src"], r["dst"]) for r in core.near_pairs_combined(spark, str(tmp_path)).collect()}
    assert (of["/b"], of["/e"]) in pairs and {x for pair in pairs for x in pair} <= set(of.values())

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsift import constants as C
from twinsift.functions import bits as B
from twinsift.functions import formatting as T
from twinsift.functions import frames as V
from twinsift.functions import pixels as P
from twinsift.functions.paths import has_extension, is_excluded
from twinsift.functions.registry import register

SIZES = {
    0: "0.00 B", 512: "512.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1536: "1.50 KB", 10240: "10.00 KB", 1024**2: "1.00 MB", 5 * 1024**2: "5.00 MB",
    1024**3: "1.00 GB", 5 * 1024**3 // 2: "2.50 GB", 1024**4: "1.00 TB", 3 * 1024**4 // 2: "1.50 TB", 2000 * 1024**4: "2000.00 TB", None: None,
}
TIMES = {0.0: "0s", 30.0: "30s", 59.0: "59s", 60.0: "1m 0s", 90.0: "1m 30s", 3599.0: "59m 59s", 3600.0: "1h 0m 0s", 3661.0: "1h 1m 1s", 7325.0: "2h 2m 5s", 59.9: "59s", 90.5: "1m 30s", float("nan"): None, float("inf"): None, None: None}


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_size_and_duration_texts(spark):
    assert column(spark, list(SIZES), "bigint", T.size_text) == list(SIZES.values())
    assert column(spark, list(TIMES), "double", T.duration_text) == list(TIMES.values())


def test_percent_agrees_with_exact_rounding(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(2000)] + [d / 256 for d in range(257)] + [round(rng.random(), 4) for _ in range(2000)] + [i / 2000 for i in range(2001)]
    assert column(spark, values, "double", T.percent_text) == [f"{v * 100:.1f}%" for v in values]


def test_resolution(spark):
    rows = spark.createDataFrame([(3, 4), (None, 4)], "w int, h int")
    assert [r[0] for r in rows.select(T.resolution_text("w", "h")).collect()] == ["3x4", None]


def test_extensions_are_one_case_and_exclusion_is_by_part_of_a_part(spark):
    names = ["/a/x.jpg", "/a/x.JPG", "/a/x.Jpg", "/a/x.mp4", "/a/jpg", None]
    assert column(spark, names, "string", lambda c: has_extension(c, C.IMAGE_EXTENSIONS)) == [True, True, False, False, False, None]
    paths = {
        "/home/u/$RECYCLE.BIN/a.jpg": True, "C:\\$Recycle.Bin\\a.jpg": True, "/u/.Trash/a": True, "/u/.git/a": True, "/p/node_modules/a": True, "/u/my_windows_pics/a.jpg": True,
        "/home/user/photos/image.jpg": False, "/var/data/videos/movie.mp4": False, "/u/photos/thumbs.jpg": True,
    }
    assert column(spark, list(paths), "string", is_excluded) == list(paths.values())
    assert column(spark, ["/u/my_windows_pics/a.jpg", "/u/Windows/a.jpg", "/u/windows"], "string", lambda c: is_excluded(c, whole_names=True)) == [False, True, False]
    assert column(spark, ["/x/Custom_Folder/a", "/x/$RECYCLE.BIN/a"], "string", lambda c: is_excluded(c, ["custom_folder"])) == [True, False]


def test_constants():
    assert (len(C.IMAGE_EXTENSIONS), len(C.VIDEO_EXTENSIONS), len(C.EXCLUDED_FOLDERS)) == (21, 21, 26)
    assert not set(C.IMAGE_EXTENSIONS) & set(C.VIDEO_EXTENSIONS)
    assert all(e.startswith(".") and e == e.lower() for e in C.IMAGE_EXTENSIONS + C.VIDEO_EXTENSIONS)


def test_words_distance_and_similarity(spark):
    rng = random.Random(2)
    pairs = [(f"{rng.getrandbits(4 * n):0{n}x}", f"{rng.getrandbits(4 * n):0{n}x}") for n in (1, 13, 16, 17, 64, 64, 100) for _ in range(5)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in rows.select(B.distance(B.hex_words("a"), B.hex_words("b"))).collect()]
    assert got == [(int(a, 16) ^ int(b, 16)).bit_count() for a, b in pairs]
    assert column(spark, ["", None, "xyz", "0x1", "ff\n", "FF"], "string", lambda c: B.hex_words(c)) == [None, None, None, None, None, [255]]
    assert column(spark, ["f" * 16], "string", lambda c: B.hex_words(c)) == [[-1]]
    assert column(spark, ["zz", None, "1", "f" * 65], "string", lambda c: B.fixed_words(c, 256)) == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1], None]


def test_threshold_distance_follows_the_double_comparison():
    assert [B.most_differing(0.92, 100), B.most_differing(0.9, 256), B.most_differing(1.0, 64)] == [8, 25, 0]


def test_bits_to_hex(spark):
    assert column(spark, [[1, 0, 1, 0, 1], [0, 0, 0, 0], [1] * 8], "array<int>", lambda c: B.bits_to_hex(c)) == ["15", "0", "ff"]


@given(st.lists(st.booleans(), min_size=1, max_size=80))
def test_hex_of_bits_keeps_the_number(bits):
    assert int(P.to_hex(np.array(bits)), 16) == int("".join("01"[b] for b in bits), 2)


def frame_places(n, k):
    """The sampler in plain arithmetic."""
    if n <= 0:
        return []
    a, z = int(n * 0.05), int(n * 0.95)
    if z <= a:
        a, z = 0, n - 1
    step = max(1, (z - a) // (k + 1))
    return [p for p in (a + i * step for i in range(1, k + 1)) if p < n]


def test_frame_indices(spark):
    counts = [*range(-2, 60), 1000, 12345]
    assert column(spark, counts, "bigint", lambda c: V.frame_indices(c, 10)) == [frame_places(n, 10) for n in counts]
    assert column(spark, [["a", "", None, "b"], [], None], "array<string>", V.frame_digest) == ["187ef4436122d1cc2f40dc2b92f0eba0", None, None]


def test_hash_choice_falls_back(spark):
    rows = spark.createDataFrame([("", "a", "d", "w"), (None, None, "", ""), ("p", "", None, None)], "phash string, ahash string, dhash string, whash string")
    got = [tuple(r) for r in rows.select(*[B.chosen_hash(k).alias(k + "_") for k in ("phash", "ahash", "whash", "combined", "other")]).collect()]
    assert got == [("a", "a", "w", "a", "a"), ("", "", "", "", ""), ("p", "p", "p", "p", "p")]


def test_cosine_transform_is_orthonormal_and_resize_keeps_constants():
    basis = P.dct_basis(32)
    assert np.allclose(basis @ basis.T, np.eye(32))
    assert (P.resize(np.full((50, 70), 77, np.uint8), 32, 16) == 77).all()
    assert P.resize(np.zeros((80, 120, 3), np.uint8), 64, 64).shape == (64, 64, 3)
    image = np.random.default_rng(0).integers(0, 256, (64, 64), np.uint8)
    assert (P.resize(image, 64, 64) == image).all()


def similarity(a, b):
    return np.mean([1 - np.mean(P.MAKERS[k](a, 16) != P.MAKERS[k](b, 16)) for k in P.MAKERS])


def test_hashes_survive_resizing_and_tell_gradients_apart():
    i, j = np.mgrid[0:200, 0:200]
    image = np.dstack([i, j, i * j % 256]).astype(np.uint8)
    patched = image.copy()
    patched[:10, :10] = 255
    assert similarity(image, image) == 1.0
    assert similarity(image, P.resize(image, 100, 100)) > 0.8
    assert similarity(image, patched) > 0.8
    assert similarity((i % 256).astype(np.uint8), (j % 256).astype(np.uint8)) < 0.9
    assert len(P.image_hashes(image, 8)["phash"]) == 16
    assert P.image_hashes(image, 12)["whash"] is None


def test_registered_sql_functions_equal_the_columns(spark):
    assert len(register(spark)) == 8
    rng = random.Random(3)
    pairs = [(f"{rng.getrandbits(4 * n):0{n}x}", f"{rng.getrandbits(4 * n):0{n}X}") for n in (2, 16, 17, 64, 64)] + [("ff", "fff"), ("zz", "ff"), (None, "ff"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    sql = [tuple(r) for r in df.selectExpr("twinsift_hamming(a, b)", "twinsift_similarity(a, b)", "twinsift_squared_similarity(a, b)").collect()]
    for (a, b), got in zip(pairs, sql):
        if a and b and len(a) == len(b) and a != "zz":
            d = (int(a, 16) ^ int(b, 16)).bit_count()
            assert got == (d, 1 - d / (4 * len(a)), 1 - d / (4 * len(a)) ** 2)
        else:
            assert got == (None, None, None)
    sizes = spark.createDataFrame([(float(v) if v is not None else None,) for v in SIZES], "v double")
    assert [r[0] for r in sizes.selectExpr("twinsift_size_text(v)").collect()] == list(SIZES.values())
    times = spark.createDataFrame([(v,) for v in TIMES], "v double")
    assert [r[0] for r in times.selectExpr("twinsift_duration_text(v)").collect()] == list(TIMES.values())
    counts = [*range(-2, 40), 999]
    places = spark.createDataFrame([(n,) for n in counts], "n long").selectExpr("twinsift_frame_indices(n, 10)").collect()
    assert [r[0] for r in places] == [frame_places(n, 10) for n in counts]
    assert spark.sql("select twinsift_resolution(2, 3), twinsift_hash_digest(array('a', '', null, 'b'))").first()[:] == ("2x3", "187ef4436122d1cc2f40dc2b92f0eba0")


def test_average_hash_of_an_image_matches_columns(spark):
    image = np.random.default_rng(3).integers(0, 256, (8, 8), np.uint8)
    from twinsift.functions.registry import hash_udf

    rows = spark.createDataFrame([(image.ravel().astype(float).tolist(),), (None,), ([1.0],)], "v array<double>")
    got = [r[0] for r in rows.select(hash_udf("ahash", 8, 8)("v")).collect()]
    assert got == [P.to_hex((image > image.mean()).ravel()), None, None]


def test_unknown_excluded_token_with_slash():
    with pytest.raises(ValueError):
        is_excluded("p", ["a/b"])

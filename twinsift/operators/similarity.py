"""Similarity joins over hashes.

Pairs of near hashes come from :mod:`twinsift.operators.hamming`, which finds every
pair within the distance that the threshold allows.  Rows of equal hashes are one
value before the join, so a hash held by a third of all rows is a single row of it;
rows are put back by joins in which a value of many rows is cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.constants import HASH_KINDS
from twinsift.functions import bits as B
from twinsift.operators import blocks
from twinsift.operators import hamming as H
from twinsift.plans.workspace import Workspace

#: Rows of one value that meet the rows of another in one task.
BLOCK_ROWS = 2_000
#: Comparisons of one task where all pairs are compared.
TASK_PAIRS = 4_000_000


def blocks_for(left: DataFrame, right: DataFrame) -> int:
    """Blocks of the right side such that a task compares about TASK_PAIRS pairs."""
    return max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() * right.count() // TASK_PAIRS))


def against_all(queries: DataFrame, rows: DataFrame, key: str, same: str | None = None) -> DataFrame:
    """Each query row beside each row (of equal column ``same``), as an equi-join over blocks of the rows: no side is broadcast, none is one task's."""
    blocks = blocks_for(queries, rows)
    left = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return left.join(right, ["_block", same] if same else ["_block"]).drop("_block")


def hash_pairs(df: DataFrame, key: str, hash_col: str, threshold: float, bits: int, single: bool = False) -> DataFrame:
    """(a, b, similarity): classes of equal hashes, named by their smallest key, of similarity ``threshold`` or more; a < b.

    Null, empty and non-hex hashes and hashes of another size than ``bits`` have no
    pairs.  Every such pair is found; copies of one hash are not expanded (see
    :func:`hash_classes`).  ``single`` compares in single precision.
    """
    most = B.most_differing(threshold, bits, single)
    work = Workspace(df.sparkSession, "hash-pairs")
    classes = hash_classes(df, key, hash_col, bits).select(F.col("leader").alias("node"), B.hex_words("hash").alias("words"))
    if most < 0:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    rows = work.save(classes.select("node", *H.word_columns("words", bits)), "classes")
    return H.near_pairs(rows, bits, most, work).select("a", "b", B.similarity(F.col("distance"), bits).alias("similarity"))


def hash_classes(df: DataFrame, key: str, hash_col: str, bits: int) -> DataFrame:
    """(hash, leader): the smallest key of each distinct hash of ``bits`` bits, in lower case."""
    text = F.lower(F.col(hash_col))
    usable = df.where(B.is_hex(text) & (F.length(text) * 4 == bits) & F.col(key).isNotNull())
    return usable.groupBy(text.alias("hash")).agg(F.min(key).alias("leader"))


def kind_similarity(x: str, y: str, kind: str, bits: int | None = None) -> Column:
    """Similarity by one hash kind, null unless both sides have the hash in the same size.

    ``bits`` is that size if it is one for all rows; the words are then columns of their
    own, which keeps the code of a comparison small enough to be compiled.
    """
    if bits is not None:
        total = F.lit(0)
        for i in range(-(-bits // 64)):
            total = total + F.bit_count(F.col(f"{x}.{kind}_w{i}").bitwiseXOR(F.col(f"{y}.{kind}_w{i}")))
        return B.similarity(total, bits)
    return F.when(F.col(f"{x}.{kind}_bits") == F.col(f"{y}.{kind}_bits"), B.similarity(B.distance(F.col(f"{x}.{kind}_words"), F.col(f"{y}.{kind}_words")), F.col(f"{x}.{kind}_bits")))


def image_similarity(x: str, y: str, hash_type: str = "combined", bits: int | None = None) -> Column:
    """Mean similarity over the kinds both sides have; 0.0 with none, and for an unknown ``hash_type``."""
    kinds = HASH_KINDS if hash_type == "combined" else [hash_type] if hash_type in HASH_KINDS else []
    if not kinds:
        return F.lit(0.0)
    # a kind that is missing adds nothing to the sum or the count
    total, count = F.lit(0.0), F.lit(0)
    for k in kinds:
        total = total + F.coalesce(kind_similarity(x, y, k, bits), F.lit(0.0))
        count = count + F.coalesce((F.col(f"{x}.{k}_bits") == F.col(f"{y}.{k}_bits")).cast("int"), F.lit(0))
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def with_words(df: DataFrame, kinds: tuple[str, ...] = HASH_KINDS) -> DataFrame:
    """Hash columns parsed once: <kind>_words and <kind>_bits."""
    for k in kinds:
        df = df.withColumn(f"{k}_words", B.hex_words(k)).withColumn(f"{k}_bits", F.when(B.is_hex(k), B.hash_bits(k)))
    return df


def image_classes(df: DataFrame, kinds: tuple[str, ...] = HASH_KINDS) -> DataFrame:
    """One row per distinct fingerprint: the kinds, and the smallest path as ``path``."""
    return df.where(F.col("path").isNotNull()).groupBy(*kinds).agg(F.min("path").alias("path"))


def image_pairs(df: DataFrame, threshold: float, hash_type: str = "combined", single: bool = False) -> DataFrame:
    """(src, dst, similarity): fingerprint classes (by smallest path) of image similarity ``threshold`` or more; src < dst.

    Exact: a mean reaches the threshold only if one of its kinds does, so the near
    values of each kind, and the classes that hold them, are compared, block by block.
    Sizes of hashes may be mixed; only equal sizes compare.  A null hash is a kind the
    row lacks.  Threshold must be above 0.  ``single`` compares in single precision.
    """
    classes, pairs = numbered_image_pairs(df, threshold, Workspace(df.sparkSession, "image-pairs"), hash_type, single)
    named = [classes.select(F.col("n").alias(n), F.col("path").alias(p)) for n, p in (("x", "src"), ("y", "dst"))]
    return pairs.join(named[0], "x").join(named[1], "y").select("src", "dst", "similarity")


def numbered_image_pairs(df: DataFrame, threshold: float, work: Workspace, hash_type: str = "combined", single: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fingerprint classes (n, path), numbered in the order of their paths, and the pairs (x, y, similarity) of :func:`image_pairs` by number, x < y."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    kinds = HASH_KINDS if hash_type == "combined" else (hash_type,) if hash_type in HASH_KINDS else ()
    ordered = with_words(image_classes(df), kinds).select("path", *[f"{k}_{x}" for k in kinds for x in ("words", "bits")]).orderBy("path")
    classes = work.save(ordered.withColumn("n", F.monotonically_increasing_id()), "classes")
    del ordered
    work.free()
    held = classes.agg(*[F.collect_set(f"{k}_bits") for k in kinds]).first() if kinds else ()
    sizes = sorted({n for found in held for n in found if n})
    schema = "x long, y long, similarity double"
    if not sizes:
        return classes.select("n", "path"), df.sparkSession.createDataFrame([], schema)
    words = -(-sizes[-1] // 64)
    code = F.lit(0).cast("long")
    columns = []
    for k in kinds:
        code = code * (len(sizes) + 1) + F.coalesce(F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col(f"{k}_bits")), F.lit(0))
        # shorter hashes are filled with zeros in front
        own = F.size(f"{k}_words")
        columns += [F.when(own >= words - i, F.get(f"{k}_words", own - (words - i))).otherwise(F.lit(0)).cast("long").alias(f"{k}_w{i}") for i in range(words)]
    most = [B.most_differing(threshold, n, single) for n in sizes]
    compare = blocks.image_pairs(kinds, sizes, words, most, threshold, single)
    return classes.select("n", "path"), blocks.own_pairs(classes.select("n", code.alias("code"), *columns), "n", classes.count(), compare, schema, work)


def between_values(near: DataFrame, values: DataFrame, rows: DataFrame, reaches: Column, value: Column) -> DataFrame:
    """(src, dst, similarity) of the rows of near values (a, b): every row of one beside every row of the other, in blocks."""
    sized = values.select("node", "blocks")
    cut = near.join(sized.select(F.col("node").alias("a"), F.col("blocks").alias("m")), "a").join(sized.select(F.col("node").alias("b"), F.col("blocks").alias("n")), "b")
    cut = cut.select("a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), "b", "n").select("a", "i", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    placed = rows.join(sized.withColumnRenamed("node", "value"), "value").withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")).drop("blocks")
    left = cut.join(placed.withColumnRenamed("value", "a").withColumnRenamed("block", "i"), ["a", "i"]).alias("p")
    # a block is at most some BLOCK_ROWS rows, so the tables of a partition are small
    right = placed.hint("shuffle_hash").alias("q")
    # rows of one value meet once, those of two values whatever their order
    meet = (F.col("p.b") == F.col("q.value")) & (F.col("p.j") == F.col("q.block")) & ((F.col("p.a") != F.col("p.b")) | (F.col("p.path") < F.col("q.path")))
    both = left.join(right, meet & reaches)
    return both.select(F.least("p.path", "q.path").alias("src"), F.greatest("p.path", "q.path").alias("dst"), value.alias("similarity"))


def similarity_matrix(queries: DataFrame, rows: DataFrame, key: str, hash_col: str, bits: int) -> DataFrame:
    """(a, b, similarity) of each query hash against each row hash: the dense product, so for a stated query set.

    Hashes are filled with zeros to ``bits``; unreadable ones are all zeros.
    """
    words = -(-bits // 64)
    left = queries.select(F.col(key).alias("a"), B.fixed_words(hash_col, bits).alias("u"))
    right = rows.select(F.col(key).alias("b"), B.fixed_words(hash_col, bits).alias("v"))
    return against_all(left, right, "b").select("a", "b", B.similarity(B.unrolled_distance("u", "v", words), bits).alias("similarity"))


def hamming_rectangle(left: DataFrame, right: DataFrame, key_a: str, hash_a: str, key_b: str, hash_b: str) -> DataFrame:
    """(a, b, distance) of every pair of readable hashes of equal size."""
    u = left.select(F.col(key_a).alias("a"), B.hex_words(hash_a).alias("u"), B.hash_bits(hash_a).alias("n")).where("u is not null")
    v = right.select(F.col(key_b).alias("b"), B.hex_words(hash_b).alias("v"), B.hash_bits(hash_b).alias("m")).where("v is not null")
    return against_all(u, v.withColumnRenamed("m", "n"), "b", "n").select("a", "b", B.distance("u", "v").alias("distance"))


def video_similarity(a: Column, b: Column, bits: int, compat: bool = False) -> Column:
    """Mean over the frames of ``a`` of their best similarity to a frame of ``b``; 0.0 if either has none.

    Frames are word arrays.  Not symmetric.  ``compat`` divides by the square of the
    bits, by which any two videos are nearly equal.
    """
    measure = B.squared_similarity if compat else B.similarity
    words = -(-bits // 64)
    best = F.transform(a, lambda x: F.greatest(F.lit(0.0), measure(F.array_min(F.transform(b, lambda y: B.unrolled_distance(x, y, words))), bits)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(best, F.lit(0.0), lambda s, p: s + p) / F.size(a)).otherwise(F.lit(0.0))


def frame_words(hashes: Column | str, bits: int) -> Column:
    """Readable frame hashes of ``bits`` bits as word arrays, in order."""
    usable = F.filter(B.col(hashes), lambda h: B.is_hex(h) & (F.length(h) * 4 == bits))
    return F.coalesce(F.transform(usable, lambda h: B.hex_words(h)), F.array().cast("array<array<bigint>>"))


def video_classes(df: DataFrame, bits: int = 256) -> DataFrame:
    """(path, frames): one row per distinct sequence of usable frame hashes, by smallest path; rows without frames are left out."""
    return video_sequences(df, bits).groupBy("frames").agg(F.min("path").alias("path"))


def video_sequences(df: DataFrame, bits: int = 256) -> DataFrame:
    """(path, frames): the usable frame hashes of every row that has some."""
    return df.where(F.col("path").isNotNull()).select("path", frame_words("frame_hashes", bits).alias("frames")).where("size(frames) > 0")


def video_pairs(
    classes: DataFrame, threshold: float, bits: int = 256, compat: bool = False, prefilter: bool = False, queries: DataFrame | None = None, directed: bool = False
) -> DataFrame:
    """(src, dst, similarity): pairs of video classes, src < dst, whose similarity reaches the threshold.

    A strict mean reaches the threshold only if some frame of ``src`` has a frame of
    ``dst`` that near, so near pairs of distinct frames are found first and the videos
    that hold them compared.  In ``compat`` mode nearly all pairs pass, and for very low
    thresholds nearly all frames are near: there all pairs are compared, block by block.
    ``prefilter`` further asks that the first frames have a similarity of
    max(0.5, threshold - 0.2), which changes results.  ``queries`` limits src to some
    classes.  ``directed`` compares src with every other class, also of smaller path: the
    similarity of (b, a) is not that of (a, b).
    """
    work = Workspace(classes.sparkSession, "video-pairs")

    def flat(df: DataFrame, name: str) -> DataFrame:
        return work.save(df.select("path", F.flatten("frames").alias("words")), name)

    right = flat(classes, "classes")
    left = right if queries is None else flat(queries, "queries")
    work.free()
    most = -1 if compat else B.most_differing(threshold, bits)
    every = compat or most >= 0.25 * bits
    compare = blocks.video_pairs(bits, threshold, None if every else most, max(0.5, threshold - 0.2) if prefilter else None, directed, compat)
    kind = right.schema["path"].dataType.simpleString()
    return blocks.cross_pairs(left, right, "path", (left.count(), right.count()), blocks.MOST_VIDEOS, compare, f"src {kind}, dst {kind}, similarity double")

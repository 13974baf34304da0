"""Duplicate groups: exact buckets, near groups, and both by the documented or the compatible rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.constants import HASH_KINDS, MATRIX_ROWS, PREFILTER_VIDEOS, PREPASS_ROWS
from twinsift.functions import bits as B
from twinsift.operators.grouping import greedy_groups
from twinsift.operators.similarity import numbered_image_pairs, video_classes, video_pairs, video_sequences
from twinsift.operators.skew import join_heads
from twinsift.plans.workspace import Workspace


def exact_groups(df: DataFrame) -> DataFrame:
    """(leader, path, similarity) of paths that share a pHash with another; similarity is 1.0, the leader the smallest path.

    Bucketing is always by pHash, in the text given.  Rows without one are in no group.
    """
    work = Workspace(df.sparkSession, "exact-groups")
    rows = df.where(F.col("phash").isNotNull() & (F.col("phash") != "")).select("path", "phash").distinct()
    rows = work.save(rows, "rows")
    heads = rows.groupBy("phash").agg(F.min("path").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return join_heads(rows, work.save(heads, "heads"), "phash", "leader", "n", rows.count()).select("leader", "path", F.lit(1.0).alias("similarity"))


def remaining_images(df: DataFrame) -> DataFrame:
    """Rows whose pHash no other path holds: what is left for the near pass."""
    usable = df.where(F.col("phash").isNotNull() & (F.col("phash") != ""))
    shared = usable.groupBy("phash").agg(F.countDistinct("path").alias("n")).where("n > 1").select("phash")
    return df.join(shared, "phash", "left_anti")


def near_image_groups(df: DataFrame, threshold: float, hash_type: str = "combined", single: bool = False) -> DataFrame:
    """(leader, path, similarity): first-come groups of similar images in path order.

    Equal fingerprints are grouped as one and then take the similarity their class has; copies
    of a leader are similar to it by 1.0 (0.0, so not grouped, where they have no hash of the type).
    """
    work = Workspace(df.sparkSession, "image-groups")
    df = work.save(df.select("path", *HASH_KINDS).distinct(), "rows")
    work.free()
    kinds = [k for k in HASH_KINDS if hash_type in (k, "combined")]
    comparable = F.exists(F.array(F.lit(False), *[F.coalesce(B.is_hex(k), F.lit(False)) for k in kinds]), lambda x: x)
    rows = work.save(class_members(df.where(comparable), work, df.count()), "members")
    work.drop("class-heads")
    # grouped by number, in the order of paths: a fifth of what the paths themselves take on disk
    classes, pairs = numbered_image_pairs(df, threshold, work, hash_type, single)
    pairs = work.save(pairs.withColumnsRenamed({"x": "src", "y": "dst"}), "pairs")
    classes = work.save(classes, "names")
    work.drop("classes", "rows")
    work.free()
    grouped = work.settle(lambda: greedy_groups(pairs), "groups")
    named = [classes.select(F.col("n").alias(n), F.col("path").alias(p)) for n, p in (("_leader", "leader"), ("_path", "path"))]
    numbers = grouped.select(F.col("leader").alias("_leader"), F.col("path").alias("_path"), "similarity")
    groups = numbers.join(named[0], "_leader").join(named[1], "_path").select("leader", "path", "similarity")
    return with_copies(groups, rows, work)


def class_members(df: DataFrame, work: Workspace, total: int) -> DataFrame:
    """(path, class, copies): the class of each path of (path, hash kinds), its smallest path, and the paths of the class.

    Equal texts of all kinds are a class.  They are told by their SHA-256, an eighth of what they take on disk.
    """
    # with its length before each text, no two rows of texts read alike
    texts = [F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("")) for k in HASH_KINDS]
    keyed = df.where(F.col("path").isNotNull()).select("path", F.unhex(F.sha2(F.concat_ws(",", *texts).cast("binary"), 256)).alias("print"))
    heads = work.save(keyed.groupBy("print").agg(F.struct(F.min("path").alias("class"), F.count("*").alias("copies")).alias("head"), F.count("*").alias("n")), "class-heads")
    return join_heads(keyed, heads, "print", "head", "n", total).select("path", "head.class", "head.copies")


def with_copies(groups: DataFrame, rows: DataFrame, work: Workspace) -> DataFrame:
    """(leader, path, similarity) of all rows (path, class, copies) from groups of classes; classes of several paths in no group are groups of their own."""
    placed = work.save(groups.select(F.col("path").alias("class"), F.struct("leader", "similarity").alias("place")), "placed")
    work.free()
    several = rows.where("copies > 1").join(placed.select("class"), "class", "left_anti").select(F.col("class").alias("leader"), "path", F.lit(1.0).alias("similarity"))
    # one row per class: the copies of a large class are not one task's
    sized = placed.join(rows.groupBy("class").agg(F.count("*").alias("n")), "class")
    grouped = join_heads(rows.select("path", "class"), sized, "class", "place", "n", rows.count())
    return grouped.select("place.leader", "path", "place.similarity").unionByName(several)


def image_groups(df: DataFrame, threshold: float = 0.9, hash_type: str = "combined", mode: str = "strict", accelerated: bool = True) -> DataFrame:
    """(phase, leader, path, similarity): duplicate groups, phase 0 exact and 1 near.

    ``strict``: exact pHash groups first, then near groups of the rest by ``hash_type``.
    ``compat``: which steps run, and by which hash, depends on the number of rows
    and ``accelerated``, as documented in the README.  ``df`` has one row per path;
    rows without a pHash are left out.
    """
    rows = df.where(F.col("phash").isNotNull() & (F.col("phash") != ""))
    if mode not in ("strict", "compat"):
        raise ValueError("mode is strict or compat")
    # read several times
    work = Workspace(df.sparkSession, "all-groups")
    rows = work.save(rows.select("path", *HASH_KINDS), "rows")
    work.free()
    if mode == "compat" and not accelerated and rows.count() <= PREPASS_ROWS:
        return near_image_groups(rows, threshold, hash_type).select(F.lit(1).alias("phase"), "leader", "path", "similarity")
    exact = exact_groups(rows)
    rest = remaining_images(rows)
    if mode == "compat" and accelerated and rest.limit(MATRIX_ROWS + 1).count() > MATRIX_ROWS:
        single = rest.select("path", B.chosen_hash(hash_type).alias("phash"), *[F.lit(None).cast("string").alias(k) for k in HASH_KINDS[1:]])
        # the dense matrix holds single-precision values
        near = near_image_groups(single, threshold, "phash", single=True)
    else:
        near = near_image_groups(rest, threshold, hash_type)
    return exact.withColumn("phase", F.lit(0)).unionByName(near.withColumn("phase", F.lit(1))).select("phase", "leader", "path", "similarity")


def video_groups(df: DataFrame, threshold: float = 0.85, mode: str = "strict", accelerated: bool = True, bits: int = 256) -> DataFrame:
    """(leader, path, similarity): first-come groups of similar videos in path order; copies of a class join with it."""
    work = Workspace(df.sparkSession, "video-groups")
    classes = work.save(video_classes(df, bits), "classes")
    compat = mode == "compat"
    prefilter = compat and accelerated and df.limit(PREFILTER_VIDEOS + 1).count() > PREFILTER_VIDEOS
    pairs = work.save(video_pairs(classes, threshold, bits, compat, prefilter), "pairs")
    groups = work.save(greedy_groups(pairs), "groups")
    rows = sequence_members(df, bits, work)
    return with_copies(groups, rows, work)


def sequence_members(df: DataFrame, bits: int, work: Workspace) -> DataFrame:
    """(path, class, copies): the class of each video with usable frames, the smallest path of its frame sequence, and the paths of the class."""
    keyed = work.save(video_sequences(df, bits).distinct(), "sequences")
    heads = keyed.groupBy("frames").agg(F.struct(F.min("path").alias("class"), F.count("*").alias("copies")).alias("head"), F.count("*").alias("n"))
    return join_heads(keyed, work.save(heads, "sequence-heads"), "frames", "head", "n", keyed.count()).select("path", "head.class", "head.copies")


def numbered_groups(groups: DataFrame, infos: DataFrame, by_size: bool = True) -> DataFrame:
    """(group_id, leader, path, similarity, rank): groups numbered by (phase, leader), members ranked.

    Images rank by falling size, ties by path; videos (``by_size`` False) in group
    order, the leader first.  A number is dense over the distinct groups, which are
    few beside the members.
    """
    phase = F.col("phase") if "phase" in groups.columns else F.lit(0)
    keyed = groups.withColumn("phase", phase)
    heads = keyed.select("phase", "leader").distinct()
    # numbering needs one order over all groups: range partitions are counted, then numbered inside; written once, so both see the same partitions
    work = Workspace(groups.sparkSession, "group-numbers")
    ordered = work.save(heads.repartitionByRange("phase", "leader").withColumn("part", F.spark_partition_id()), "ordered")
    counts = ordered.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("phase", "leader"))
    numbers = ordered.withColumn("inside", inside).join(F.broadcast(counts.select("part", "before")), "part").select("phase", "leader", (F.col("inside") + F.col("before")).cast("int").alias("group_id"))
    sized = keyed.join(infos.select("path", "file_size"), "path", "left").join(numbers, ["phase", "leader"])
    order = [F.coalesce("file_size", F.lit(0)).desc(), F.col("path")] if by_size else [(F.col("path") != F.col("leader")), F.col("path")]
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(*order))
    return sized.select("group_id", "leader", "path", "similarity", rank.alias("rank"))

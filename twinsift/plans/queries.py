"""Queries over the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.constants import DEFAULT_NUM_FRAMES, HASH_KINDS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from twinsift.functions import bits as B
from twinsift.functions import formatting as T
from twinsift.functions import frames as V
from twinsift.functions.paths import has_extension, is_excluded
from twinsift.functions.registry import hash_udf
from twinsift.operators import report as R
from twinsift.operators import similarity as S
from twinsift.operators.groups import class_members, exact_groups, image_groups, near_image_groups, numbered_groups, remaining_images, sequence_members, video_groups
from twinsift.operators.skew import compress, top_record, weighted_percentiles, weighted_summary
from twinsift.plans.workspace import Workspace


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def usable(column: str, digits: int) -> Column:
    text = F.lower(F.trim(F.col(column)))
    return F.when((F.length(text) == digits) & text.rlike(f"^[0-9a-f]{{{digits}}}$"), text)


def hash_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(media, hash_key, id, file_size) of images by phash and videos by average_hash."""
    images = table(spark, folder, "images").select(F.lit("image").alias("media"), usable("phash", 64).alias("hash_key"), F.col("image_id").alias("id"), "file_size")
    videos = table(spark, folder, "videos").select(F.lit("video").alias("media"), usable("average_hash", 32).alias("hash_key"), F.col("video_id").alias("id"), "file_size")
    return images.unionByName(videos).where("hash_key is not null")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_record(hash_rows(spark, folder), ["media", "hash_key"], "id", F.col("file_size")).select("media", "hash_key", "top_id")


def p4_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct sizes, the commonest size, and size percentiles of each hash."""
    keys = ["media", "hash_key"]
    weighted = Workspace(spark, "summary").save(compress(hash_rows(spark, folder), keys, F.col("file_size")), "weighted")
    middle = weighted_percentiles(weighted, keys, [0.5, 0.9])
    ranks = middle.groupBy(*keys).agg(F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("share") == 0.9, F.col("value"))).alias("p90"))
    return weighted_summary(weighted, keys).join(ranks, keys, "left").select(*keys, "records", "n_values", "mode", "mode_weight", "p50", "p90")



def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per path: the one ingested last."""
    last = [F.col(c).desc_nulls_last() for c in ("ingested_at", "scanned_at", "file_size", "width", "height")]
    return R.latest_rows(table(spark, folder, "images"), last)


def video_rows(spark: SparkSession, folder: str) -> DataFrame:
    last = [F.col(c).desc_nulls_last() for c in ("ingested_at", "scanned_at", "file_size", "width", "height", "duration")]
    return R.latest_rows(table(spark, folder, "videos"), last)


def valid_images(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints with a pHash of 256 bits; other hashes that are not are null."""
    rows = image_rows(spark, folder)
    for k in HASH_KINDS:
        rows = rows.withColumn(k, usable(k, 64))
    return rows.where("phash is not null")


def all_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "images").select("path").unionByName(table(spark, folder, "videos").select("path"))


def scan_extension_filter(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(has_extension("path", IMAGE_EXTENSIONS), "image").when(has_extension("path", VIDEO_EXTENSIONS), "video")
    return all_paths(spark, folder).where("path is not null").select("path", kind.alias("media")).where("media is not null").distinct()


def scan_exclusion_filter(spark: SparkSession, folder: str) -> DataFrame:
    return all_paths(spark, folder).where("path is not null").where(~is_excluded("path")).select("path").distinct()


def scan_distinct_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return all_paths(spark, folder).where("path is not null").distinct().orderBy("path")


def fingerprint_filter(spark: SparkSession, folder: str) -> DataFrame:
    images = image_rows(spark, folder).where(F.col("phash").isNotNull() & (F.col("phash") != "")).select("path")
    return images.unionByName(video_rows(spark, folder).where(F.size("frame_hashes") > 0).select("path"))


def hash_select_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return image_rows(spark, folder).select("path", *[B.chosen_hash(k).alias(f"by_{k}") for k in (*HASH_KINDS, "combined")])


def hex_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Each pHash as packed words, and the text made of these words again."""
    rows = valid_images(spark, folder).select("path", B.hex_words("phash").alias("w"))
    back = F.concat(*[F.lpad(F.lower(F.hex(F.col("w")[i])), 16, "0") for i in range(4)])
    return rows.select("path", back.alias("back"), *[F.col("w")[i].alias(f"w{i}") for i in range(4)])


def exact_hash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(valid_images(spark, folder))


def remaining_after_exact(spark: SparkSession, folder: str) -> DataFrame:
    return remaining_images(valid_images(spark, folder)).select("path")


def near_pairs_phash(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct pHashes, each named by its smallest path."""
    return S.hash_pairs(valid_images(spark, folder), "path", "phash", 0.9, 256)


def near_pairs_combined(spark: SparkSession, folder: str) -> DataFrame:
    return S.image_pairs(valid_images(spark, folder), 0.9)


def image_class_members(spark: SparkSession, folder: str) -> DataFrame:
    """(path, class_path): every image and the class that near_pairs_combined knows it by, the smallest path equal to it in all four hashes."""
    work = Workspace(spark, "image-members")
    rows = work.save(valid_images(spark, folder).select("path", *HASH_KINDS), "rows")
    return class_members(rows, work, rows.count()).select("path", F.col("class").alias("class_path"))


def near_groups_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """First-come groups by mean similarity, without the exact pass."""
    return near_image_groups(valid_images(spark, folder), 0.9)


def fast_groups_union(spark: SparkSession, folder: str) -> DataFrame:
    return image_groups(valid_images(spark, folder), 0.9, "phash")


def group_ranked_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_images(spark, folder)
    return numbered_groups(exact_groups(rows), rows)


def numbered_near_members(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and near groups numbered together, exact ones first."""
    groups = Workspace(spark, "numbered").settle(lambda: image_groups(valid_images(spark, folder), 0.9, "phash"), "groups")
    return numbered_groups(groups, image_rows(spark, folder))


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, h): embeddings as 8 x 8 grey images, each pixel against the median, as 16 hex digits."""
    middle = (F.col("o")[31] + F.col("o")[32]) / 2
    rows = grid(spark, folder).withColumn("o", F.array_sort("p"))
    bits = B.let(middle, lambda m: F.transform("p", lambda x: (x > m).cast("int")))
    return rows.select("vec_id", B.bits_to_hex(bits).alias("h"))


def median_hash_bits(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder)


def grid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("size(embedding) = 64").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))


def ahash_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Each pixel against the mean, rounded: sums of doubles differ in their last bit between engines."""
    mean = F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) / 64, 9)
    return grid(spark, folder).select("vec_id", B.bits_to_hex(B.let(mean, lambda m: F.transform("p", lambda x: (x > m).cast("int")))).alias("h"))


def dhash_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Each pixel against its left neighbour."""
    inner = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 8 != 0)
    right = F.transform(inner, lambda i: (F.get("p", i) > F.get("p", i - 1)).cast("int"))
    return grid(spark, folder).select("vec_id", B.bits_to_hex(right).alias("h"))


def whash_haar_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Means of 2 x 2 blocks (the Haar low band, up to scale) against their median."""
    corners = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i / 4).cast("int") * 16 + (i % 4) * 2)
    low = F.transform(corners, lambda c: F.round((F.get("p", c) + F.get("p", c + 1) + F.get("p", c + 8) + F.get("p", c + 9)) / 4, 9))
    ordered = F.array_sort("low")
    bits = B.let((F.col("o")[7] + F.col("o")[8]) / 2, lambda m: F.transform("low", lambda x: (x > m).cast("int")))
    return grid(spark, folder).withColumn("low", low).withColumn("o", ordered).select("vec_id", B.bits_to_hex(bits).alias("h"))


def mosaic_phash_bits(spark: SparkSession, folder: str) -> DataFrame:
    """pHash (cosine transform, low block, median) of 32 x 32 mosaics of 16 consecutive embeddings, levels scaled to 0..255."""
    return mosaics(spark, folder).select("mosaic", hash_udf("phash", 8, 32)("levels").alias("h"))


def mosaic_pixel_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The other hashes of the mosaics by the library's own functions: resized, then against the mean, the left neighbour, or the median of block means."""
    return mosaics(spark, folder).select("mosaic", *[hash_udf(k, 8, 32)("levels").alias(k) for k in ("ahash", "dhash", "whash")])


def mosaics(spark: SparkSession, folder: str) -> DataFrame:
    """(mosaic, levels): 32 x 32 grey levels from 16 consecutive embeddings."""
    tiles = grid(spark, folder).select(F.floor(F.col("vec_id") / 16).alias("mosaic"), (F.col("vec_id") % 16).alias("tile"), "p")
    held = tiles.groupBy("mosaic").agg(F.array_sort(F.collect_list(F.struct("tile", "p"))).alias("t")).where("size(t) = 16")
    level = F.transform(F.flatten(F.transform("t", lambda t: t["p"])), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x + 1) * 127.5).cast("double"))))
    return held.select("mosaic", level.alias("levels"))


def similarity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors whose id is divisible by 20 against all vectors."""
    rows = codes(spark, folder)
    return S.similarity_matrix(rows.where("vec_id % 20 = 0"), rows, "vec_id", "h", 64)


def hamming_rectangular(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted images whose id is divisible by 20 against the distinct usable pHashes."""
    known = table(spark, folder, "known_media").where("media = 'image' and known_id % 20 = 0").select("known_id", usable("phash", 64).alias("h"))
    hashes = S.hash_classes(valid_images(spark, folder), "path", "phash", 256)
    return S.hamming_rectangle(known, hashes, "known_id", "h", "leader", "hash")


def frame_sampling(spark: SparkSession, folder: str) -> DataFrame:
    places = F.concat_ws(",", F.transform(V.frame_indices("frame_count", DEFAULT_NUM_FRAMES), lambda i: i.cast("string")))
    return video_rows(spark, folder).select("video_id", "frame_count", places.alias("frames"))


def video_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return video_rows(spark, folder).select("video_id", V.effective_fps("fps").alias("fps"), F.round(V.duration("frame_count", "fps"), 6).alias("duration"))


def video_average_hash(spark: SparkSession, folder: str) -> DataFrame:
    return video_rows(spark, folder).select("video_id", V.frame_digest("frame_hashes").alias("average_hash"))


def clean_videos(spark: SparkSession, folder: str) -> DataFrame:
    frames = F.filter(F.transform("frame_hashes", lambda h: F.lower(F.trim(h))), lambda h: F.length(h) == 64)
    return video_rows(spark, folder).select("video_id", "path", frames.alias("frame_hashes"), "file_size", "width", "height", "duration")


def video_matches(spark: SparkSession, folder: str, threshold: float, compat: bool, prefilter: bool) -> DataFrame:
    """Distinct frame sequences whose smallest id is divisible by 20, against all distinct sequences."""
    rows = clean_videos(spark, folder).select(F.col("video_id").alias("path"), "frame_hashes")
    classes = S.video_classes(rows)
    pairs = S.video_pairs(classes, threshold, 256, compat, prefilter, classes.where("path % 20 = 0"))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def video_similarity_strict(spark: SparkSession, folder: str) -> DataFrame:
    return video_matches(spark, folder, 0.85, False, False)


def video_similarity_compat(spark: SparkSession, folder: str) -> DataFrame:
    return video_matches(spark, folder, 0.9965, True, False)


def video_prefilter_refine(spark: SparkSession, folder: str) -> DataFrame:
    return video_matches(spark, folder, 0.9965, True, True)


def video_sequence_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(frames, path, asked): distinct frame sequences by smallest id, and whether any of their ids is divisible by 20."""
    rows = S.video_sequences(clean_videos(spark, folder).select(F.col("video_id").alias("path"), "frame_hashes"))
    return rows.groupBy("frames").agg(F.min("path").alias("path"), F.max(F.col("path") % 20 == 0).alias("asked"))


def video_query_matches(spark: SparkSession, folder: str, threshold: float, compat: bool, prefilter: bool) -> DataFrame:
    """Every sequence held by a video whose id is divisible by 20, against all other sequences, of smaller id too.

    :func:`video_class_members` has the videos of a sequence; those of one sequence have similarity 1 and no row here.
    """
    classes = video_sequence_classes(spark, folder)
    pairs = S.video_pairs(classes, threshold, 256, compat, prefilter, classes.where("asked"), directed=True)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def video_queries_strict(spark: SparkSession, folder: str) -> DataFrame:
    return video_query_matches(spark, folder, 0.85, False, False)


def video_queries_compat(spark: SparkSession, folder: str) -> DataFrame:
    return video_query_matches(spark, folder, 0.9965, True, False)


def video_queries_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return video_query_matches(spark, folder, 0.9965, True, True)


def video_class_members(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, class_id): every video with usable frames, and the smallest id of its frame sequence."""
    rows = clean_videos(spark, folder).select(F.col("video_id").alias("path"), "frame_hashes")
    return sequence_members(rows, 256, Workspace(spark, "video-members")).select(F.col("path").alias("video_id"), F.col("class").alias("class_id"))


def video_groups_strict(spark: SparkSession, folder: str) -> DataFrame:
    return video_groups(clean_videos(spark, folder), 0.85).withColumn("similarity", F.round("similarity", 6))


def earlier_groups(spark: SparkSession, folder: str) -> DataFrame:
    """dup_groups without repeated rows."""
    return table(spark, folder, "dup_groups").groupBy("group_id", "media", "leader", "path").agg(F.max("similarity").alias("similarity"), F.min("rank").alias("rank"))


def group_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.group_report(earlier_groups(spark, folder).where("media = 'image'"), image_rows(spark, folder).select("path", "width", "height", "file_size", "format"))


def group_report_videos(spark: SparkSession, folder: str) -> DataFrame:
    return R.group_report(earlier_groups(spark, folder).where("media = 'video'"), video_rows(spark, folder).select("path", "width", "height", "file_size", "duration"), "video")


def infos(spark: SparkSession, folder: str) -> DataFrame:
    return image_rows(spark, folder).select("path", "file_size").unionByName(video_rows(spark, folder).select("path", "file_size"))


def group_savings(spark: SparkSession, folder: str) -> DataFrame:
    return R.group_savings(earlier_groups(spark, folder), infos(spark, folder))


def duplicate_totals(spark: SparkSession, folder: str) -> DataFrame:
    return R.totals(group_savings(spark, folder))


def format_size(spark: SparkSession, folder: str) -> DataFrame:
    return infos(spark, folder).where("file_size is not null").select("file_size", T.size_text("file_size").alias("size")).distinct()


def format_duration(spark: SparkSession, folder: str) -> DataFrame:
    return video_rows(spark, folder).select("video_id", T.duration_text("duration").alias("text"))


def resolution_label(spark: SparkSession, folder: str) -> DataFrame:
    return image_rows(spark, folder).select("image_id", T.resolution_text("width", "height").alias("resolution"))


def similarity_percent(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_edges").where("similarity is not null and not isnan(similarity)").select("similarity", T.percent_text("similarity").alias("text")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p4_found, p4_summary, scan_extension_filter, scan_exclusion_filter, scan_distinct_sorted, fingerprint_filter,
        hash_select_fallback, hex_roundtrip, median_hash_bits, ahash_bits, dhash_bits, whash_haar_bits, mosaic_phash_bits, mosaic_pixel_hashes,
        exact_hash_groups, remaining_after_exact, near_pairs_phash, near_pairs_combined, image_class_members, near_groups_greedy, fast_groups_union,
        group_ranked_members, numbered_near_members, similarity_matrix, hamming_rectangular, frame_sampling, video_metadata, video_average_hash,
        video_similarity_strict, video_similarity_compat, video_prefilter_refine, video_groups_strict, video_queries_strict,
        video_queries_compat, video_queries_prefilter, video_class_members, group_report,
        group_report_videos, group_savings, duplicate_totals, format_size, format_duration, resolution_label, similarity_percent,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from twinsift.plans.oracle import SQL

    return dict(SQL)

"""Reading media files into fingerprint rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.constants import DEFAULT_HASH_SIZE, DEFAULT_NUM_FRAMES, FALLBACK_FPS
from twinsift.functions import pixels
from twinsift.functions.frames import frame_digest, frame_indices
from twinsift.schema import IMAGE_ROW, VIDEO_ROW
from twinsift.sources.decoders import ImageDecoder, VideoDecoder, VideoFile, any_video, image_decoder, read_bytes

#: How files of each format begin, in hex.
SIGNATURES = {"PNG": "89504e470d0a1a0a", "JPEG": "ffd8ff", "GIF": "47494638", "BMP": "424d", "TIFF": "49492a00", "TIFF ": "4d4d002a", "WEBP": "52494646"}


def pixels_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """An image of Spark's reader (BGR or BGRA bytes) as grey or RGB(A) levels."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return image[:, :, 0]
    return image[:, :, [2, 1, 0, 3][:channels]]


def decoded_images(files: DataFrame, hash_size: int, kinds: tuple[str, ...], decoder: ImageDecoder) -> DataFrame:
    """Image rows by a decoder of bytes: each file is opened once, in the task that holds its row."""
    names = [c.split()[0] for c in IMAGE_ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                data = read_bytes(path)
                found = decoder(data) if data is not None else None
                made: dict = dict.fromkeys(pixels.MAKERS)
                if found is not None:
                    made |= pixels.image_hashes(found.pixels, hash_size, kinds)
                sides = found.pixels.shape[:2] if found is not None else (0, 0)
                size = len(data) if data is not None else 0 if length != length or length is None else int(length)
                rows.append((path, sides[1], sides[0], size, found.format if found else "", found.mode if found else "", *[made[k] for k in pixels.MAKERS]))
            yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "length").mapInPandas(run, IMAGE_ROW.replace(" NOT NULL", ""))


def read_images(
    spark: SparkSession, files: DataFrame, hash_size: int = DEFAULT_HASH_SIZE, kinds: tuple[str, ...] = tuple(pixels.MAKERS), decoder: ImageDecoder | None = None
) -> DataFrame:
    """Image rows of (path, length) files: size, format, mode and the hashes asked for.

    Files that are missing or cannot be decoded give a row with null hashes and zero
    dimensions.  With a ``decoder`` (by default Pillow's, where Pillow is installed)
    files are read where their rows lie.  Without one Spark's image source decodes
    them; it takes named files, so the list of paths then goes through the driver.
    """
    decoder = decoder or image_decoder()
    if decoder is not None:
        return decoded_images(files, hash_size, kinds, decoder)

    def there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[("://" in p and not p.startswith("file://")) or os.path.isfile(p.removeprefix("file://")) for p in batch["path"]]]

    every = files.select("path", "length").where("path is not null")
    rows = image_source_rows(spark, every.mapInPandas(there, "path string, length long"), hash_size, kinds)
    lost = every.join(rows.select("path"), "path", "left_anti")
    nothing = {"width": F.lit(0), "height": F.lit(0), "format": F.lit(""), "mode": F.lit("")} | {k: F.lit(None).cast("string") for k in pixels.MAKERS}
    return rows.unionByName(lost.select("path", F.coalesce("length", F.lit(0)).cast("long").alias("file_size"), *[c.alias(n) for n, c in nothing.items()]))


def image_source_rows(spark: SparkSession, files: DataFrame, hash_size: int, kinds: tuple[str, ...]) -> DataFrame:
    """Image rows of existing files by Spark's image source."""
    # characters a reader would take as a pattern
    names = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r[0]) for r in files.select("path").toLocalIterator()]
    columns = "origin string, width int, height int, mode string, phash string, ahash string, dhash string, whash string"
    if not names:
        return spark.createDataFrame([], IMAGE_ROW.replace(" NOT NULL", ""))
    raw = spark.read.format("image").option("dropInvalid", "false").load(names).select("image.*")
    label = {1: "L", 3: "RGB", 4: "RGBA"}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                made: dict = dict.fromkeys(pixels.MAKERS)
                good = r.width > 0 and r.height > 0 and r.nChannels in label
                if good:
                    made |= pixels.image_hashes(pixels_of(r.data, r.height, r.width, r.nChannels), hash_size, kinds)
                rows.append((r.origin, max(r.width, 0), max(r.height, 0), label[r.nChannels] if good else "", *[made[k] for k in pixels.MAKERS]))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "mode", *pixels.MAKERS]).astype(object)

    local = F.regexp_replace("path", "^file:/*(?=/)", "")
    seen = raw.mapInPandas(hashed, columns).withColumn("path", F.regexp_replace("origin", "^file:/*(?=/)", ""))
    heads = spark.read.format("binaryFile").load(names).select(local.alias("path"), "length", F.lower(F.hex(F.substring("content", 1, 8))).alias("head"))
    kind = F.lit("")
    for name, start in SIGNATURES.items():
        kind = F.when(F.col("head").startswith(start), name.strip()).otherwise(kind)
    joined = heads.join(seen, "path", "left")
    return joined.select(
        "path", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), F.col("length").alias("file_size"),
        F.when(F.coalesce("width", F.lit(0)) > 0, kind).otherwise("").alias("format"), F.coalesce("mode", F.lit("")).alias("mode"), *pixels.MAKERS,
    )


def usable_images(rows: DataFrame) -> DataFrame:
    """Rows with a pHash."""
    return rows.where(F.col("phash").isNotNull() & (F.col("phash") != ""))


def read_videos(files: DataFrame, decoder: VideoDecoder = any_video, frames: int = DEFAULT_NUM_FRAMES, hash_size: int = DEFAULT_HASH_SIZE) -> DataFrame:
    """Video rows of (path, length) files, decoded where the rows lie.

    A file the decoder cannot open, or without frames, keeps its size and has no hashes.
    """
    opened = "path string, length long, fps double, frame_count long, width int, height int"

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                video = decoder(path)
                v = video[0] if video else VideoFile(0.0, 0, 0, 0)
                rows.append((path, length, (v.fps or FALLBACK_FPS) if video else 0.0, v.frame_count, v.width, v.height))
            yield pd.DataFrame(rows, columns=["path", "length", "fps", "frame_count", "width", "height"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, places in zip(batch["path"], batch["places"]):
                video = decoder(path) if len(places) else None
                shots = [video[1](int(i)) for i in places] if video else []
                texts = [pixels.image_hashes(s, hash_size, ("phash",))["phash"] for s in shots if s is not None]
                found.append([t for t in texts if t])
            yield batch.drop(columns=["places"]).assign(frame_hashes=pd.Series(found, dtype=object, index=batch.index))

    known = files.select("path", "length").mapInPandas(facts, opened)
    placed = known.withColumn("places", frame_indices("frame_count", frames))
    hashed = placed.mapInPandas(hashes, opened + ", frame_hashes array<string>")
    length = F.when((F.col("frame_count") > 0) & (F.col("fps") > 0), F.col("frame_count") / F.col("fps")).otherwise(0.0)
    names = [c.split()[0] for c in VIDEO_ROW.split(", ")]
    return hashed.select("*", length.alias("duration"), F.col("length").alias("file_size"), frame_digest("frame_hashes").alias("average_hash")).select(*names)


def usable_videos(rows: DataFrame) -> DataFrame:
    """Rows with a frame hash."""
    return rows.where(F.size("frame_hashes") > 0)

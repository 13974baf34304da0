"""Finders: scan a folder, fingerprint its files, group duplicates, report.

Every step is lazy and returns a DataFrame; ``rows`` accumulates what was
fingerprinted, the last row of a path counting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinsift.constants import DEFAULT_HASH_SIZE, DEFAULT_IMAGE_THRESHOLD, DEFAULT_NUM_FRAMES, DEFAULT_VIDEO_THRESHOLD
from twinsift.operators.groups import image_groups, numbered_groups, video_groups
from twinsift.operators.similarity import frame_words, image_similarity, video_similarity, with_words
from twinsift.schema import IMAGE_EXPORT, IMAGE_ROW, VIDEO_EXPORT, VIDEO_ROW
from twinsift.sinks.report import print_report
from twinsift.sources.catalog import find_images, find_videos
from twinsift.sources.decoders import ImageDecoder, VideoDecoder, any_video
from twinsift.sources.media import read_images, read_videos, usable_images, usable_videos


def check_threshold(value: float) -> float:
    if not 0 < value <= 1:
        raise ValueError("Threshold must be between 0 and 1")
    return value


def newer_rows(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.join(new.select("path"), "path", "left_anti").unionByName(new)


@dataclass
class ImageFinder:
    spark: SparkSession
    threshold: float = DEFAULT_IMAGE_THRESHOLD
    hash_size: int = DEFAULT_HASH_SIZE
    hash_type: str = "combined"
    mode: str = "strict"
    accelerated: bool = True
    decoder: ImageDecoder | None = None
    rows: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        check_threshold(self.threshold)

    def find(self, folder: str, hidden: bool = False) -> DataFrame:
        return find_images(self.spark, folder, hidden=hidden)

    def process(self, files: DataFrame) -> DataFrame:
        """Fingerprint files and add the usable ones to ``rows``."""
        return self.add(read_images(self.spark, files, self.hash_size, decoder=self.decoder))

    def add(self, rows: DataFrame) -> DataFrame:
        """Add rows fingerprinted elsewhere."""
        self.rows = newer_rows(self.rows, usable_images(rows))
        return self.rows

    def similarity(self, a: Row | dict, b: Row | dict) -> float:
        """Similarity of two image rows by the finder's hash type."""
        names = ["phash", "ahash", "dhash", "whash"]
        pair = [self.spark.createDataFrame([{n: dict(r.asDict() if isinstance(r, Row) else r).get(n) for n in names}], ", ".join(f"{n} string" for n in names)) for r in (a, b)]
        x, y = (with_words(p).alias(n) for p, n in zip(pair, "xy"))
        return x.join(y, F.lit(True)).select(image_similarity("x", "y", self.hash_type)).first()[0]

    def duplicates(self) -> DataFrame:
        """(group_id, leader, path, similarity, rank)."""
        rows = self.rows if self.rows is not None else self.spark.createDataFrame([], IMAGE_ROW)
        return numbered_groups(image_groups(rows, self.threshold, self.hash_type, self.mode, self.accelerated), rows)

    def export(self) -> DataFrame:
        return self.rows.select(*IMAGE_EXPORT)

    def report(self, groups: DataFrame, output: str | None = None) -> None:
        print_report(groups, self.rows, "image", output)


@dataclass
class VideoFinder:
    spark: SparkSession
    threshold: float = DEFAULT_VIDEO_THRESHOLD
    frames: int = DEFAULT_NUM_FRAMES
    hash_size: int = DEFAULT_HASH_SIZE
    mode: str = "strict"
    accelerated: bool = True
    decoder: VideoDecoder = any_video
    rows: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        check_threshold(self.threshold)

    def find(self, folder: str, hidden: bool = False) -> DataFrame:
        return find_videos(self.spark, folder, hidden=hidden)

    def process(self, files: DataFrame) -> DataFrame:
        return self.add(read_videos(files, self.decoder, self.frames, self.hash_size))

    def add(self, rows: DataFrame) -> DataFrame:
        self.rows = newer_rows(self.rows, usable_videos(rows))
        return self.rows

    def similarity(self, a: Row | dict, b: Row | dict) -> float:
        bits = self.hash_size**2
        held = [list((r.asDict() if isinstance(r, Row) else r).get("frame_hashes") or []) for r in (a, b)]
        frame = self.spark.createDataFrame([tuple(held)], "a array<string>, b array<string>")
        return frame.select(video_similarity(frame_words("a", bits), frame_words("b", bits), bits, self.mode == "compat")).first()[0]

    def duplicates(self) -> DataFrame:
        rows = self.rows if self.rows is not None else self.spark.createDataFrame([], VIDEO_ROW)
        return numbered_groups(video_groups(rows, self.threshold, self.mode, self.accelerated, self.hash_size**2), rows, by_size=False)

    def export(self) -> DataFrame:
        return self.rows.select(*VIDEO_EXPORT)

    def report(self, groups: DataFrame, output: str | None = None) -> None:
        print_report(groups, self.rows, "video", output)


__all__ = ["ImageFinder", "VideoFinder", "check_threshold"]

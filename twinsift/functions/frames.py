"""Video frames: which to look at, and the digest of their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.constants import FALLBACK_FPS, SKIPPED_SHARE
from twinsift.functions.bits import col


def frame_indices(frame_count: Column | str, frames: int) -> Column:
    """Positions of ``frames`` evenly spaced frames between the skipped ends, those beyond the last left out; empty without frames."""
    n = col(frame_count).cast("long")
    begin, end = (n.cast("double") * SKIPPED_SHARE).cast("long"), (n.cast("double") * (1 - SKIPPED_SHARE)).cast("long")
    narrow = end <= begin
    first, last = F.when(narrow, F.lit(0).cast("long")).otherwise(begin), F.when(narrow, n - 1).otherwise(end)
    step = F.greatest(F.lit(1).cast("long"), F.floor((last - first) / (frames + 1)).cast("long"))
    places = F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: first + i * step)
    return F.when(n > 0, F.filter(places, lambda p: p < n)).otherwise(F.array().cast("array<bigint>"))


def frame_digest(frame_hashes: Column | str) -> Column:
    """MD5 of the hashes in frame order, empty ones left out; null without hashes."""
    kept = F.filter(col(frame_hashes), lambda h: h.isNotNull() & (h != ""))
    return F.when(F.size(kept) > 0, F.md5(F.array_join(kept, "")))


def effective_fps(fps: Column | str) -> Column:
    f = col(fps)
    return F.when(f.isNull() | (f == 0), F.lit(FALLBACK_FPS)).otherwise(f)


def duration(frame_count: Column | str, fps: Column | str) -> Column:
    n, f = col(frame_count), effective_fps(fps)
    return F.when((n > 0) & (f > 0), n / f).otherwise(F.lit(0.0))

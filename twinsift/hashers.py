"""Hashers of single files, without Spark."""

from __future__ import annotations

import hashlib
import logging
import os

import numpy as np

from twinsift.constants import DEFAULT_HASH_SIZE, DEFAULT_NUM_FRAMES, FALLBACK_FPS, SKIPPED_SHARE
from twinsift.functions import pixels
from twinsift.sources.decoders import ImageDecoder, VideoDecoder, any_video, image_decoder, read_bytes

log = logging.getLogger(__name__)


class ImageHasher:
    """Image rows of single files, as dicts of the columns of ``IMAGE_ROW``."""

    def __init__(self, hash_size: int = DEFAULT_HASH_SIZE, decoder: ImageDecoder | None = None) -> None:
        self.hash_size = hash_size
        self.decoder = decoder or image_decoder()

    def hash_pixels(self, image: np.ndarray) -> dict[str, str | None]:
        """The hashes of grey or RGB levels."""
        return pixels.image_hashes(image, self.hash_size)

    def hash_file(self, path: str) -> dict:
        """The row of a file; one that is missing or cannot be decoded has no hashes, and a warning is logged."""
        row = {"path": path, "width": 0, "height": 0, "file_size": 0, "format": "", "mode": "", **dict.fromkeys(pixels.MAKERS)}
        data = read_bytes(path)
        found = self.decoder(data) if data is not None and self.decoder else None
        row["file_size"] = len(data or b"")
        if found is None:
            log.warning("no image could be read from %s", path)
            return row
        height, width = found.pixels.shape[:2]
        return row | {"width": width, "height": height, "format": found.format, "mode": found.mode} | self.hash_pixels(found.pixels)


class VideoHasher:
    """Video rows of single files, as dicts of the columns of ``VIDEO_ROW``."""

    def __init__(self, frames: int = DEFAULT_NUM_FRAMES, hash_size: int = DEFAULT_HASH_SIZE, decoder: VideoDecoder = any_video) -> None:
        self.frames, self.hash_size, self.decoder = frames, hash_size, decoder

    def frame_places(self, count: int) -> list[int]:
        """Positions of evenly spaced frames, as :func:`twinsift.functions.frames.frame_indices` has them."""
        if count <= 0:
            return []
        begin, end = int(count * SKIPPED_SHARE), int(count * (1 - SKIPPED_SHARE))
        if end <= begin:
            begin, end = 0, count - 1
        step = max(1, (end - begin) // (self.frames + 1))
        return [p for p in range(begin + step, begin + self.frames * step + 1, step) if p < count]

    def hash_frame(self, frame: np.ndarray) -> str:
        """The pHash of a frame, empty where it cannot be hashed."""
        return pixels.image_hashes(frame, self.hash_size, ("phash",))["phash"] or ""

    def hash_file(self, path: str) -> dict:
        """The row of a file; one that cannot be opened keeps its size and has no hashes."""
        size = os.path.getsize(path) if os.path.exists(path) else 0
        row = {"path": path, "duration": 0.0, "fps": 0.0, "frame_count": 0, "width": 0, "height": 0, "file_size": size, "frame_hashes": [], "average_hash": None}
        opened = self.decoder(path) if size else None
        if opened is None:
            log.warning("no video could be read from %s", path)
            return row
        facts, frame = opened
        fps = facts.fps or FALLBACK_FPS
        shots = [s for s in (frame(i) for i in self.frame_places(facts.frame_count)) if s is not None]
        hashes = [h for h in map(self.hash_frame, shots) if h]
        digest = hashlib.md5("".join(hashes).encode()).hexdigest() if hashes else None
        length = facts.frame_count / fps if facts.frame_count > 0 and fps > 0 else 0.0
        return row | {"duration": length, "fps": fps, "frame_count": facts.frame_count, "width": facts.width, "height": facts.height, "frame_hashes": hashes, "average_hash": digest}

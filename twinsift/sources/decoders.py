"""Decoders of image and video files: functions from bytes or a path to pixels.

Libraries are imported where a file is decoded, so none is needed to import this.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class ImageFile:
    """A decoded image: grey (height, width) or RGB (height, width, 3) levels, and what the file says of itself."""

    pixels: np.ndarray
    format: str
    mode: str


@dataclass
class VideoFile:
    """What a decoder knows of a video before any frame is read."""

    fps: float
    frame_count: int
    width: int
    height: int


#: Bytes of a file to an image, or None where they cannot be decoded.
ImageDecoder = Callable[[bytes], "ImageFile | None"]
#: A path to the facts of a video and a function index -> RGB frame (or None), or None where it cannot be opened.
VideoDecoder = Callable[[str], "tuple[VideoFile, Callable[[int], np.ndarray | None]] | None"]


def pillow_decoder(data: bytes) -> ImageFile | None:
    """Any format Pillow reads.  Modes other than RGB and L are converted to RGB, or to L where that fails."""
    from PIL import Image

    try:
        with Image.open(io.BytesIO(data)) as image:
            kind, mode = image.format or "", image.mode
            if mode not in ("RGB", "L"):
                try:
                    image = image.convert("RGB")
                except (ValueError, OSError):
                    image = image.convert("L")
            return ImageFile(np.asarray(image), kind, mode)
    except (OSError, ValueError, SyntaxError):
        return None


def image_decoder() -> ImageDecoder | None:
    """Pillow's decoder where Pillow is installed, else None: Spark's image source decodes then."""
    return pillow_decoder if importlib.util.find_spec("PIL") else None


def array_decoder(path: str):
    """Videos kept as arrays: an .npz file with ``frames`` (n, height, width[, 3]) and ``fps``, whatever its name ends in."""
    try:
        held = np.load(path, allow_pickle=False)
        frames, fps = held["frames"], float(held["fps"])
    except (OSError, ValueError, KeyError, IndexError, TypeError):
        return None
    return VideoFile(fps, len(frames), frames.shape[2], frames.shape[1]), lambda i: frames[i] if 0 <= i < len(frames) else None


def opencv_decoder(path: str):
    """Any video OpenCV reads; frames are sought by index."""
    import cv2

    video = cv2.VideoCapture(path)
    if not video.isOpened():
        return None
    facts = VideoFile(video.get(cv2.CAP_PROP_FPS), int(video.get(cv2.CAP_PROP_FRAME_COUNT)), int(video.get(cv2.CAP_PROP_FRAME_WIDTH)), int(video.get(cv2.CAP_PROP_FRAME_HEIGHT)))

    def frame(index: int) -> np.ndarray | None:
        video.set(cv2.CAP_PROP_POS_FRAMES, index)
        good, picture = video.read()
        return np.ascontiguousarray(picture[:, :, ::-1]) if good else None

    return facts, frame


def any_video(path: str):
    """Arrays, else what OpenCV reads where it is installed."""
    found = array_decoder(path)
    if found is None and importlib.util.find_spec("cv2"):
        found = opencv_decoder(path)
    return found


def read_bytes(path: str) -> bytes | None:
    """The content of a local file or of one of a file system that pyarrow knows; None where there is no such file."""
    try:
        if "://" in path and not path.startswith("file://"):
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_stream(inner) as f:
                return f.read()
        with open(path.removeprefix("file://"), "rb") as f:
            return f.read()
    except OSError:
        return None

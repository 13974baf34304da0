"""Perceptual hashes of pixel arrays, vectorised over equal-sized images where that helps."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from twinsift.constants import LUMA


def luma(image: np.ndarray) -> np.ndarray:
    """Grey levels of an RGB(A) image as uint8; a grey image is only cast."""
    return (image[..., :3] @ np.array(LUMA) if image.ndim == 3 else image).astype(np.uint8)


def axis_weights(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower neighbour, upper neighbour and weight of the upper one, pixel centres at half positions, edges repeated."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    low = np.floor(at).astype(int)
    share = at - low
    return np.clip(low, 0, source - 1), np.clip(low + 1, 0, source - 1), share


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize of a grey or colour uint8 image."""
    a, b, u = axis_weights(image.shape[0], height)
    c, d, v = axis_weights(image.shape[1], width)
    u = u.reshape(-1, *[1] * (image.ndim - 1))
    v = v.reshape(1, -1, *[1] * (image.ndim - 2))
    pixels = image.astype(np.float64)
    rows = pixels[a] * (1 - u) + pixels[b] * u
    return np.clip(np.rint(rows[:, c] * (1 - v) + rows[:, d] * v), 0, 255).astype(np.uint8)


@lru_cache(maxsize=16)
def dct_basis(size: int) -> np.ndarray:
    """Orthonormal DCT-II as a matrix."""
    k, i = np.arange(size)[:, None], np.arange(size)[None]
    basis = np.cos(np.pi * (2 * i + 1) * k / (2 * size)) * np.sqrt(2 / size)
    basis[0] /= np.sqrt(2)
    return basis


def dct2(image: np.ndarray) -> np.ndarray:
    """2-D DCT-II over the last two axes."""
    rows, cols = dct_basis(image.shape[-2]), dct_basis(image.shape[-1])
    return rows @ image @ cols.T


def phash_bits(image: np.ndarray, hash_size: int) -> np.ndarray:
    """Low DCT frequencies of the image at four times the hash size, against their median."""
    low = dct2(resize(luma(image), 4 * hash_size, 4 * hash_size).astype(np.float64))[:hash_size, :hash_size]
    return (low > np.median(low)).ravel()


def ahash_bits(image: np.ndarray, hash_size: int) -> np.ndarray:
    """Pixels of the image at hash size against their mean."""
    small = resize(luma(image), hash_size, hash_size).astype(np.float64)
    return (small > small.mean()).ravel()


def dhash_bits(image: np.ndarray, hash_size: int) -> np.ndarray:
    """Each pixel against its left neighbour."""
    small = resize(luma(image), hash_size + 1, hash_size).astype(np.int16)
    return (small[:, 1:] > small[:, :-1]).ravel()


def whash_bits(image: np.ndarray, hash_size: int) -> np.ndarray | None:
    """The Haar low band (block means) of the image at a power of two, against its median; None unless the hash size is one."""
    if hash_size & (hash_size - 1):
        return None
    side = max(hash_size, 1 << (min(image.shape[:2]).bit_length() - 1))
    grey = resize(luma(image), side, side).astype(np.float64)
    block = side // hash_size
    low = grey.reshape(hash_size, block, hash_size, block).mean(axis=(1, 3))
    return (low > np.median(low)).ravel()


def to_hex(bits: np.ndarray) -> str:
    """Bits as hex text, first bit most significant, padded in front to whole digits."""
    padded = np.r_[np.zeros(-len(bits) % 4, bool), bits.astype(bool)]
    nibbles = padded.reshape(-1, 4) @ np.array([8, 4, 2, 1])
    return "".join("0123456789abcdef"[n] for n in nibbles)


MAKERS = {"phash": phash_bits, "ahash": ahash_bits, "dhash": dhash_bits, "whash": whash_bits}


def image_hashes(image: np.ndarray, hash_size: int, kinds: tuple[str, ...] = tuple(MAKERS)) -> dict[str, str | None]:
    """Hex hashes of the kinds asked for; a kind that fails is None and does not take others with it."""
    out: dict[str, str | None] = {}
    for kind in kinds:
        try:
            bits = MAKERS[kind](image, hash_size)
            out[kind] = None if bits is None else to_hex(bits)
        except (ValueError, IndexError):
            out[kind] = None
    return out

"""Scans of whole text columns as byte arrays: words, lines and tokens of many documents at once.

A batch of texts is one UTF-8 buffer with offsets, as Arrow delivers it; the masks
and prefix sums here replace a loop over documents and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds the scratch arrays of a task to some 100 MB unless one text alone is longer.
CHUNK_BYTES = 2_000_000

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
TOKEN = LETTER.copy()
TOKEN[[*range(48, 58), 95]] = True
STOP = np.zeros(256, bool)
STOP[[33, 46, 63]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def starts_of(offsets: np.ndarray, length: int) -> np.ndarray:
    """Mask of the first byte of every text."""
    first = np.zeros(length, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return first


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of maximal runs of a mask that do not cross the begin of a text."""
    before = np.r_[False, mask[:-1]]
    begin = np.nonzero(mask & (~before | first))[0]
    after = np.r_[~mask[1:] | first[1:], True] if len(mask) else mask
    return begin, np.nonzero(mask & after)[0] + 1


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true bytes in every text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo 2 ** 64, kept for the life of the worker."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < count:
        kept = np.empty(max(count, 1 << 16), np.uint64)
        kept[0] = 1
        done = 1
        step = base
        while done < len(kept):  # doubling
            more = min(done, len(kept) - done)
            kept[done : done + more] = kept[:more] * step
            step = step * step
            done += more
        if count <= 4 * CHUNK_BYTES:
            _powers[str(base)] = kept
    return kept[:count]


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2 ** 64 of values[begin:end] for many ranges; equal ranges hash alike wherever they lie."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=total[1:])
        return (total[end] - total[begin]) * powers(UNBASE, len(values) + 1)[begin] + (end - begin).astype(np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the maximal runs of ASCII letters, digits and ``_``, case folded."""
    begin, end = runs(TOKEN[data], starts_of(offsets, len(data)))
    return begin, end, range_hashes(LOWER[data], begin, end)

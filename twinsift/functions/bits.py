"""Hashes as packed bits: hex text, 64-bit words, Hamming distance and similarity, all as column expressions.

A hash of n hex digits has 4 n bits.  Its words are the digits from the right in
groups of 16, so the first word may be short and leading zeros cost nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_hex(text: Column | str) -> Column:
    return col(text).rlike(r"\A[0-9a-fA-F]+\z")


def hex_words(text: Column | str) -> Column:
    """Hex text as an array of signed 64-bit words; null for null, empty or other text."""
    t = col(text)
    digits = (F.ceil(F.length(t) / 16) * 16).cast("int")
    padded = F.lpad(t, digits, "0")
    words = F.transform(F.sequence(F.lit(1), digits, F.lit(16)), lambda i: F.conv(F.substring(padded, i, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(is_hex(t), words)


def fixed_words(text: Column | str, bits: int) -> Column:
    """As :func:`hex_words`, filled with zeros to ``bits``; unreadable text is all zeros, a longer hash null."""
    t = F.when(is_hex(text), col(text)).otherwise(F.lit("0"))
    width = -(-bits // 64) * 16
    return F.when(F.length(t) * 4 <= bits, hex_words(F.lpad(t, width, "0")))


def hash_bits(text: Column | str) -> Column:
    return 4 * F.length(col(text))


def distance(left: Column | str, right: Column | str) -> Column:
    """Differing bits of two word arrays; null where either is null or their sizes differ."""
    a, b = col(left), col(right)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def unrolled_distance(left: Column | str, right: Column | str, words: int) -> Column:
    """Differing bits of two arrays of a known number of words, without a lambda; null where either is null."""
    a, b = col(left), col(right)
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, words):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def reaching(value: Column, threshold: float) -> Column:
    """The value as a row if it reaches the threshold, else no row.

    A filter on a computed column would move below the projection and compute it twice.
    """
    return F.explode(F.filter(F.array(value), lambda s: s >= threshold))


def similarity(differing: Column, bits: Column | int) -> Column:
    return 1 - differing / (F.lit(bits) if isinstance(bits, int) else bits)


def squared_similarity(differing: Column, bits: Column | int) -> Column:
    """Similarity over the square of the bits: what the compatible video mode compares by."""
    b = F.lit(bits) if isinstance(bits, int) else bits
    return 1 - differing / (b * b)


def most_differing(threshold: float, bits: int, single: bool = False) -> int:
    """The largest distance whose similarity reaches the threshold, by the arithmetic of the comparison, double or ``single``; -1 if none."""
    kind = np.float32 if single else float
    return max((d for d in range(bits + 1) if kind(1 - d / bits) >= kind(threshold)), default=-1)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: as the variable of a lambda it is not repeated wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bits_to_hex(bits: Column | str) -> Column:
    """An array of 0/1 as hex text, first bit most significant, padded in front to whole digits."""

    def digits(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(text), F.lit(4))
        return F.concat_ws("", F.transform(starts, lambda i: F.lower(F.conv(F.substring(text, i, F.lit(4)), 2, 16))))

    joined = F.concat_ws("", F.transform(col(bits), lambda b: b.cast("string")))
    return let(joined, lambda t: digits(F.lpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "0")))


def chosen_hash(kind: str) -> Column:
    """The hash of a kind, or the first usable one of phash, ahash, dhash, else empty text."""
    filled = [F.nullif(F.col(k), F.lit("")) for k in ("phash", "ahash", "dhash")]
    first = F.coalesce(*filled, F.lit(""))
    if kind in ("phash", "ahash", "dhash", "whash"):
        return F.coalesce(F.nullif(F.col(kind), F.lit("")), first)
    return first

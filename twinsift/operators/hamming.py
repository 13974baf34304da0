"""Pairs of bit vectors that differ in few bits: exact multi-index hashing, sized by the data.

The bits are cut into parts, each with a reach.  If the numbers ``reach + 1`` of all
parts sum to the allowed distance plus one, vectors within that distance differ in
some part by no more than its reach (pigeonhole).  Stored vectors write one key per
part.  Probing vectors look up every value within the reach of the part, so the
enumeration is on the probing side only and stored keys stay few.

Few wide parts with a reach mean many look-ups and few chance meetings, many narrow
ones the reverse.  :func:`plan_parts` takes the mix that is cheapest for the number of
rows, so candidates per row grow far more slowly than the table.  Any plan is exact;
it only decides what the join costs.

A key held by very many vectors is refined by keys of the other bits, in which the
pair must agree in one of enough bands too, so a hot value is split before it is joined.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators import blocks
from twinsift.plans.workspace import Workspace

#: Relative costs of a stored key, a look-up, and a meeting of two vectors in a key.
KEY_COST, LOOK_UP_COST, MEETING_COST = 1.0, 1.0, 0.04
WIDEST_PART = 60
#: A key is hot if it holds this many vectors and this share of all keys: at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1024, 1e-5
#: Vectors that decide which keys are hot; the list matters for speed alone.
HOT_SAMPLE = 100_000


@dataclass(frozen=True)
class Part:
    """Bits begin..end, counted from the most significant, looked up within ``reach`` differing bits."""

    begin: int
    end: int
    reach: int

    @property
    def look_ups(self) -> int:
        return sum(comb(self.end - self.begin, i) for i in range(self.reach + 1))

    @property
    def chance(self) -> float:
        """Probability that two unrelated vectors meet in this part."""
        return self.look_ups / 2.0 ** (self.end - self.begin)


def cut_parts(bits: int, reaches: tuple[int, ...]) -> tuple[Part, ...]:
    """Parts of these reaches over all bits, widths such that all have about the same chance."""
    widths = [1] * len(reaches)
    heap = [(-Part(0, 1, r).chance, i) for i, r in enumerate(reaches)]
    heapq.heapify(heap)
    for _ in range(bits - len(reaches)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        widths[i] += 1
        if widths[i] < WIDEST_PART:
            heapq.heappush(heap, (-Part(0, widths[i], reaches[i]).chance, i))
    parts, begin = [], 0
    for width, reach in zip(widths, reaches):
        parts.append(Part(begin, begin + width, reach))
        begin += width
    return tuple(parts)


@lru_cache(maxsize=256)
def plan_parts(bits: int, differing: int, stored: int, probing: int, look_up_cost: float = LOOK_UP_COST) -> tuple[Part, ...]:
    """The cheapest parts to find all vectors within ``differing`` bits among ``stored`` ones by ``probing`` ones."""
    if not 0 <= differing < bits:
        raise ValueError("the distance must be at least 0 and below the number of bits")
    total = differing + 1
    best: tuple[float, tuple[Part, ...]] | None = None
    for low in range(3):
        # parts of reach low and low + 1, and one smaller part for the remainder
        for high in range(0, total // (low + 2) + 1, max(1, total // 32)):
            full, rest = divmod(total - high * (low + 2), low + 1)
            reaches = (low + 1,) * high + (low,) * full + ((rest - 1,) if rest else ())
            if not reaches:
                continue
            parts = cut_parts(bits, reaches)
            looks = sum(p.look_ups for p in parts)
            if looks > 5_000:
                continue
            cost = KEY_COST * len(parts) * stored + look_up_cost * looks * probing + MEETING_COST * probing * stored * sum(p.chance for p in parts)
            if best is None or cost < best[0]:
                best = cost, parts
    return best[1]


def bit_range(begin: int, end: int, bits: int) -> str:
    """Bits begin..end (from the most significant of ``bits``) of the word columns, at most 63 of them, as one number, in SQL."""
    pad = -bits % 64
    begin, end = begin + pad, end + pad
    value = ""
    for word in range(begin // 64, (end - 1) // 64 + 1):
        a, b = max(begin, 64 * word), min(end, 64 * word + 64)
        piece = f"(shiftrightunsigned(w{word}, {64 * word + 64 - b}) & {(1 << (b - a)) - 1}L)"
        value = f"(shiftleft({value}, {b - a}) | {piece})" if value else piece
    return value


def bit_ranges(cuts: list[tuple[int, int]], bits: int) -> Column:
    """Numbers of several bit ranges as an array.  One text: a call per operation would cost more than the work on a small batch."""
    return F.expr("array(" + ", ".join(bit_range(a, b, bits) for a, b in cuts) + ")")


def word_names(bits: int) -> list[str]:
    return [f"w{i}" for i in range(-(-bits // 64))]


def word_columns(words: Column | str, bits: int) -> list[Column]:
    """An array of words as the columns w0, w1, ... that this module works on."""
    w = F.col(words) if isinstance(words, str) else words
    return [w[i].alias(n) for i, n in enumerate(word_names(bits))]


def distance(x: str, y: str, bits: int) -> Column:
    """Differing bits of the word columns of two aliased tables."""
    return F.expr(" + ".join(f"bit_count({x}.{n} ^ {y}.{n})" for n in word_names(bits)))


def numbers(values: list[list[int]], kind: str) -> Column:
    """A constant array of arrays, parsed as one text: thousands of literals cost thousands of calls."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{v}{kind}" for v in row) + ")" for row in values) + ")")


def flips(part: Part) -> list[int]:
    """Every number that changes up to ``reach`` bits of a part."""
    width = part.end - part.begin
    return [sum(1 << b for b in chosen) for n in range(part.reach + 1) for chosen in combinations(range(width), n)]


def keyed(rows: DataFrame, parts: tuple[Part, ...], bits: int, probing: bool) -> DataFrame:
    """The rows once per key: (..., part, key).  Rows have the word columns of ``bits``."""
    values = bit_ranges([(p.begin, p.end) for p in parts], bits)
    out = rows.select("*", F.posexplode(values).alias("part", "_value"))
    value = F.col("_value")
    if probing and any(p.reach for p in parts):
        out = out.withColumn("_flip", F.explode(F.element_at(numbers([flips(p) for p in parts], "L"), F.col("part") + 1)))
        value = value.bitwiseXOR(F.col("_flip"))
    return out.withColumn("key", F.xxhash64("part", value)).drop("_value", "_flip")


def other_bands(parts: tuple[Part, ...], bits: int, differing: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """A grid of bands, and for each part the bands outside it: more than ``differing``, so near vectors agree in one of them."""
    widest = max(p.end - p.begin for p in parts)
    count = differing + 2
    while count < bits and count - (-(-widest // (bits // count)) + 1) <= differing:
        count += 1
    count = min(count, bits)
    edges = [bits * i // count for i in range(count + 1)]
    grid = [(a, min(b, a + 63)) for a, b in zip(edges, edges[1:])]
    return grid, [[i for i, (a, b) in enumerate(grid) if b <= p.begin or a >= p.end] for p in parts]


def refine_hot(rows: DataFrame, hot: DataFrame, parts: tuple[Part, ...], bits: int, differing: int) -> DataFrame:
    """Rows of hot keys once per band outside the part of the key, with keys of both; other rows as they are."""
    grid, outside = other_bands(parts, bits, differing)
    # with too few bits outside a part its key cannot be refined without losing pairs
    outside = [o if len(o) > differing else [-1] for o in outside]
    out = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left")
    bands = F.when(F.col("_hot"), F.element_at(numbers(outside, ""), F.col("part") + 1)).otherwise(F.array(F.lit(-1)))
    out = out.withColumn("_band", F.explode(bands))
    value = F.element_at(bit_ranges(grid, bits), F.col("_band") + 1)
    return out.withColumn("key", F.when(F.col("_band") >= 0, F.xxhash64("key", "_band", value)).otherwise(F.col("key"))).drop("_hot", "_band")


def hot_keys(stored: DataFrame, count: int, parts: tuple[Part, ...], bits: int) -> DataFrame:
    """(key) of many vectors, estimated from a share of the vectors; at most 1 / HOT_SHARE of them."""
    share = min(1.0, HOT_SAMPLE / max(1, count))
    part = stored if share == 1.0 else stored.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000))
    least = max(HOT_ROWS * share, len(parts) * count * share * HOT_SHARE, 2)
    return keyed(part, parts, bits, False).groupBy("key").count().where(F.col("count") > least).select("key")


def near_pairs(rows: DataFrame, bits: int, differing: int, work: Workspace, name: str = "near", probing: DataFrame | None = None, parts: tuple[Part, ...] | None = None) -> DataFrame:
    """(a, b, distance): every pair of nodes whose vectors differ in ``differing`` bits or fewer, each once; a < b.

    ``rows`` is (node, w0, w1, ...), one row per node.  Blocks of them are compared (see
    :mod:`twinsift.operators.blocks`): keys and look-ups, hundreds a row, are never shuffled.
    With ``probing``, of the same form, a is a node of that and b one
    of ``rows``, in any order and equal nodes included.  No rows give no pairs.
    """
    names = word_names(bits)
    if not 0 <= differing < bits:
        raise ValueError("the distance must be at least 0 and below the number of bits")
    numbered = rows.select("node", F.monotonically_increasing_id().alias("n"), *names)
    numbered = work.save(numbered, f"{name}-numbered")
    count = numbered.count()
    vectors, compare, schema = numbered.select("n", *names), blocks.vector_pairs(names, bits, differing, parts), "x long, y long, distance int"
    left = numbered.select(F.col("n").alias("x"), F.col("node").alias("a"))
    right = numbered.select(F.col("n").alias("y"), F.col("node").alias("b"))
    if probing is None:
        found = blocks.own_pairs(vectors, "n", count, compare, schema).join(left, "x").join(right, "y")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    asked = work.save(probing.select("node", F.monotonically_increasing_id().alias("n"), *names), f"{name}-asked")
    found = blocks.cross_pairs(asked.select("n", *names), vectors, "n", (asked.count(), count), blocks.MOST_ROWS, compare, schema)
    return found.join(asked.select(F.col("n").alias("x"), F.col("node").alias("a")), "x").join(right, "y").select("a", "b", "distance")

"""Near pairs block against block, in numpy: what is looked up and compared never leaves a task.

Rows are cut into blocks and a task (a cell) gets two of them, so a row is sent once per
cell it is in: with n blocks n times, whatever the number of its keys.  Inside a cell the
multi-index hashing of :mod:`twinsift.operators.hamming` runs on arrays, or all pairs are
compared where that is cheaper.  Every choice is exact; it decides only what a cell costs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.plans.workspace import Workspace

#: Rows of a block at most, and so few that no further cut pays.
MOST_ROWS, LEAST_ROWS = 250_000, 2_000
#: Videos of a block at most.
MOST_VIDEOS = 25_000
#: Copies of all rows that are shuffled at once.
COPIES = 4
#: Relative costs of a stored key, a look-up, a meeting in a key, and a comparison where all pairs are compared.
KEY_COST, LOOK_UP_COST, MEETING_COST, PAIR_COST = 10.0, 1.0, 2.5, 0.6
#: Pairs and look-ups held at once.
HELD = 100_000
#: Pairs of rows of two values beyond which their other kinds are searched too.
LARGE = 200_000
#: Keys of at most so many bits are found in a table of all their values, wider ones by bisection.
TABLE_BITS = 23


@lru_cache(maxsize=256)
def plan_cell(bits: int, differing: int, stored: int, probing: int) -> tuple | None:
    """Parts as in :func:`hamming.plan_parts`, by the costs of a cell; None where comparing all pairs is cheaper."""
    from twinsift.operators.hamming import cut_parts

    best = PAIR_COST * stored * probing, None
    for reach in range(4):
        full, rest = divmod(differing + 1, reach + 1)
        reaches = (reach,) * full + ((rest - 1,) if rest else ())
        if len(reaches) > bits:
            continue
        parts = cut_parts(bits, reaches)
        looks = sum(p.look_ups for p in parts)
        if looks > 20_000:
            break
        cost = KEY_COST * len(parts) * stored + LOOK_UP_COST * looks * probing + MEETING_COST * stored * probing * sum(p.chance for p in parts)
        if cost < best[0]:
            best = cost, parts
    return best[1]


def bit_values(words: list[np.ndarray], begin: int, end: int, bits: int) -> np.ndarray:
    """Bits begin..end (from the most significant of ``bits``), at most 63 of them, as numbers."""
    pad = -bits % 64
    begin, end = begin + pad, end + pad
    value: np.ndarray | None = None
    for word in range(begin // 64, (end - 1) // 64 + 1):
        a, b = max(begin, 64 * word), min(end, 64 * word + 64)
        piece = words[word] >> np.uint64(64 * word + 64 - b) & np.uint64((1 << (b - a)) - 1)
        value = piece if value is None else value << np.uint64(b - a) | piece
    return value


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes laid end to end: the range of each place, and the place within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive places whose sizes sum to about ``most``, each of one place at least."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + most, "right")))
        yield begin, end
        begin = end


def within(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs within ``most``: word by word, so most unrelated pairs cost one word."""
    span = None
    for k in range(len(x)):
        w = (first + k) % len(x)
        more = np.bitwise_count(x[w][i] ^ y[w][j])
        span = more.astype(np.int32) if span is None else span + more
        keep = span <= most
        i, j, span = i[keep], j[keep], span[keep]
    return i, j, span


def near_indices(x: list[np.ndarray], y: list[np.ndarray] | None, bits: int, most: int, parts: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all vectors i of x and j of y within ``most`` differing bits, each pair once; without y, of x itself and i < j.

    Vectors are columns of 64-bit words.
    """
    own = y is None
    y = x if own else y
    n, m = len(x[0]), len(y[0])
    if not n or not m:
        return
    parts = parts or plan_cell(bits, most, m, n)
    if parts:
        # values of many vectors: what the keys would bring together
        meet = 0
        for p in parts:
            (a, ca), (b, cb) = (np.unique(bit_values(v, p.begin, p.end, bits), return_counts=True) for v in (x, y))
            _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            meet += int((ca[at].astype(np.float64) * cb[bt]).sum())
        if meet * MEETING_COST > n * m * PAIR_COST:
            parts = None
    if not parts:
        step = max(1, HELD // m)
        for begin in range(0, n, step):
            i, j = (v.ravel() for v in np.meshgrid(np.arange(begin, min(n, begin + step)), np.arange(begin if own else 0, m), indexing="ij"))
            if own:
                i, j = i[i < j], j[i < j]
            yield within(x, y, i, j, most)
        return
    for at, p in enumerate(parts):
        width = p.end - p.begin
        keys = bit_values(y, p.begin, p.end, bits)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        if width <= TABLE_BITS:
            starts = np.r_[0, np.cumsum(np.bincount(keys.astype(np.int64), minlength=1 << width))].astype(np.int32)
            held = np.diff(starts)
        else:
            values, starts = np.unique(keys[order], return_index=True)
            starts = np.r_[starts, m]
        flips = np.array(_flips(p), np.uint64)
        asked = bit_values(x, p.begin, p.end, bits)
        first = ((p.end - 1 + (-bits % 64)) // 64 + 1) % len(x)
        step = max(1, HELD // len(flips))
        for begin in range(0, n, step):
            wanted = (asked[begin : begin + step, None] ^ flips[None, :]).ravel()
            if width <= TABLE_BITS:
                slot = wanted.astype(np.int64)
                size = held[slot]
            else:
                slot = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                size = np.where(values[slot] == wanted, starts[slot + 1] - starts[slot], 0)
            hit = np.flatnonzero(size)
            slot, size, probe = slot[hit], size[hit], begin + hit // len(flips)
            for a, b in runs(size, HELD):
                owner, place = spread(size[a:b])
                i, j = probe[a:b][owner], order[starts[slot[a:b]][owner] + place]
                if own:
                    keep = i < j
                    i, j = i[keep], j[keep]
                i, j, span = within(x, y, i, j, most, first)
                # a pair belongs to the first part that it agrees in
                both = [u[i] ^ v[j] for u, v in zip(x, y)]
                fresh = np.ones(len(i), bool)
                for q in parts[:at]:
                    fresh &= np.bitwise_count(bit_values(both, q.begin, q.end, bits)) > q.reach
                if fresh.any():
                    yield i[fresh], j[fresh], span[fresh]


@lru_cache(maxsize=256)
def _flips(part) -> list[int]:
    from twinsift.operators.hamming import flips

    return flips(part)


def cell_function(compare: Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]]) -> Callable:
    """For applyInArrow: compare(left, right) of the rows of a cell; right is None where a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        side = rows["side"].to_numpy()
        if (side == 2).all():
            yield from compare(rows, None)
        else:
            yield from compare(rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1)))

    return run


def cut(count: int, tasks: int) -> int:
    """Blocks of ``count`` rows of which every two, or one and itself, are a cell, with some cells for each of ``tasks``."""
    return max(1, -(-count // MOST_ROWS), min(math.ceil(math.sqrt(2.5 * tasks)), -(-count // LEAST_ROWS)))


def _spread_cells(rows: DataFrame, cells: int, compare: Callable, schema: str) -> DataFrame:
    return rows.repartition(3 * cells if cells > 1 else 1, "cell").groupBy("cell").applyInArrow(cell_function(compare), schema)


def turns(n: int) -> list[list[tuple[int, int]]]:
    """The cells (block, block) of n blocks, cut so that each part sends every row to about COPIES cells."""
    cells = [(p, q) for p in range(n) for q in range(p + 1, n)] + [(p, p) for p in range(n)]
    ends = np.cumsum([1 + (p != q) for p, q in cells])
    part = (ends - 1) // (COPIES * n)
    return [[cells[i] for i in np.flatnonzero(part == t)] for t in range(part[-1] + 1)]


def own_pairs(rows: DataFrame, key: str, count: int, compare: Callable, schema: str, work: Workspace | None = None, name: str = "cells") -> DataFrame:
    """compare() over cells that bring every two of the ``count`` rows together once.

    With ``work``, more than COPIES blocks are compared in turns whose results are written there, so
    the disk of the shuffle stays at COPIES times the rows however many blocks there are.
    """
    n = cut(count, rows.sparkSession.sparkContext.defaultParallelism)
    if work is not None and n > COPIES:
        for turn, cells in enumerate(turns(n)):
            ends = sorted({(p, q) for c in cells for p, q in (c, c[::-1])})
            others = F.broadcast(rows.sparkSession.createDataFrame(ends, "_block int, _other int"))
            placed = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).join(others, "_block")
            found = work.save(_own_cells(placed, rows.columns, n, len(cells), compare, schema), f"{name}-{turn}")
            work.free()
        return work.read_all(f"{name}-*", found)
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    placed = rows.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _own_cells(placed, rows.columns, n, n * (n + 1) // 2, compare, schema)


def _own_cells(placed: DataFrame, columns: list[str], n: int, cells: int, compare: Callable, schema: str) -> DataFrame:
    """compare() over the cells of rows placed by their block of n and another."""
    cell = F.least("_block", "_other") * n + F.greatest("_block", "_other")
    side = F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1)
    return _spread_cells(placed.select(cell.alias("cell"), side.alias("side"), *columns), cells, compare, schema)


def cross_pairs(left: DataFrame, right: DataFrame, key: str, counts: tuple[int, int], most: int, compare: Callable, schema: str) -> DataFrame:
    """compare() over cells that bring every row of ``left`` and ``right``, of the same columns, together once; blocks of ``most`` rows or fewer."""
    tasks = 3 * left.sparkSession.sparkContext.defaultParallelism
    blocks = [max(1, -(-c // most)) for c in counts]
    while blocks[0] * blocks[1] < tasks:
        # the side whose rows a further cut of the other repeats least
        k = 0 if counts[1] * blocks[0] < counts[0] * blocks[1] else 1
        if counts[k] // blocks[k] < LEAST_ROWS // 10:
            break
        blocks[k] += 1
    m, n = blocks

    def placed(rows: DataFrame, own: int, others: int, cell: Callable[[Column, Column], Column], side: int) -> DataFrame:
        at = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return at.select(cell(F.col("_block"), F.col("_other")).alias("cell"), F.lit(side).alias("side"), *rows.columns)

    both = placed(left, m, n, lambda b, o: b * n + o, 0).unionByName(placed(right, n, m, lambda b, o: o * n + b, 1))
    return _spread_cells(both, m * n, compare, schema)


def word_arrays(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [np.ascontiguousarray(table[n].to_numpy()).view(np.uint64) for n in names]


def batches(columns: dict[str, np.ndarray | pa.Array], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Columns as batches of bounded size."""
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=rows)


def vector_pairs(names: list[str], bits: int, most: int, parts: tuple | None) -> Callable:
    """Comparison of cells of (n, words): (x, y, distance)."""

    def compare(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        a, x = left["n"].to_numpy(), word_arrays(left, names)
        b, y = (a, None) if right is None else (right["n"].to_numpy(), word_arrays(right, names))
        for i, j, span in near_indices(x, y, bits, most, parts):
            yield from batches({"x": a[i], "y": b[j], "distance": span})

    return compare


def groups_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of these columns as groups: (a row of each group, the rows in the order of groups, where each group begins in it, sizes)."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return order[begin], order, begin, np.diff(np.r_[begin, len(order)])


def products(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of ranges of these sizes, every place of one with every place of the other: (pair, place, other place), about ``most`` at once."""
    for a, b in runs(left * right, most):
        # the rows of one side first, so that a large pair is cut too
        owner, place = spread(left[a:b])
        width = right[a:b][owner]
        for c, d in runs(width, most):
            at, other = spread(width[c:d])
            yield a + owner[c:d][at], place[c:d][at], other


def image_pairs(kinds: tuple[str, ...], sizes: list[int], words: int, most: list[int], threshold: float, single: bool) -> Callable:
    """Comparison of cells of (n, code, <kind>_w0, ...): (x, y, similarity) of the rows whose mean similarity reaches the threshold, x < y.

    ``code`` has a digit per kind in base len(sizes) + 1, 0 for a missing hash.  ``most``
    is the distance a kind of each size may have alone; a pair belongs to its first kind
    within that.  Rows are put together by value, and by code, so that all pairs of two
    groups have the same kinds.
    """
    base = len(sizes) + 1

    def digit(code: np.ndarray | int, k: int) -> np.ndarray | int:
        return code // base ** (len(kinds) - 1 - k) % base

    def grouped(code: np.ndarray, w: list[np.ndarray], k: int, size: int) -> tuple:
        """Distinct values of a kind of one size, and the groups of each: (values, first group, groups, code, first row, rows of each group), and the rows."""
        rows = np.flatnonzero(digit(code, k) == size)
        own = [c[rows] for c in w]
        some, order, begin, count = groups_of(*own, code[rows])
        values = [c[some] for c in own]
        heads, by, first, held = groups_of(*values)  # groups are in the order of values already
        return [c[heads] for c in values], first, held, code[rows][some], begin, count, rows[order]

    def compare(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        own = right is None
        sides = [left] if own else [left, right]
        n = [t["n"].to_numpy() for t in sides]
        codes = [t["code"].to_numpy() for t in sides]
        held = [{k: word_arrays(t, [f"{k}_w{i}" for i in range(words)]) for k in kinds} for t in sides]
        for at, k in enumerate(kinds):
            for number, size in enumerate(sizes, 1):
                if most[number - 1] < 0:
                    continue
                g = [grouped(c, h[k], at, number) for c, h in zip(codes, held)]
                a, b = g[0], g[-1]
                used = -(-size // 64)
                for i, j, _ in near_values(a[0], None if own else b[0], used, size, most[number - 1]):
                    for pair, p, q in products(a[2][i], b[2][j], HELD):
                        # groups of near values; those of one value meet once
                        p, q, same = a[1][i[pair]] + p, b[1][j[pair]] + q, own & (i[pair] == j[pair])
                        keep = ~same | (p <= q)
                        p, q = p[keep], q[keep]
                        both = a[3][p] * base ** len(kinds) + b[3][q]
                        for mix in np.unique(both):
                            found = both == mix
                            yield from compared(n, held, own, at, a[4:], b[4:], p[found], q[found], int(mix) // base ** len(kinds), int(mix) % base ** len(kinds))

    def near_values(x: list[np.ndarray], y: list[np.ndarray] | None, used: int, size: int, reach: int) -> Iterator:
        yield from near_indices(x[-used:], y and y[-used:], size, reach)
        if y is None:
            same = np.arange(len(x[0]))
            yield same, same, same

    def compared(n: list, held: list, own: bool, at: int, a: tuple, b: tuple, p: np.ndarray, q: np.ndarray, code: int, other: int) -> Iterator[pa.RecordBatch]:
        shared = [(k, sizes[digit(code, i) - 1], i) for i, k in enumerate(kinds) if digit(code, i) and digit(code, i) == digit(other, i)]
        lost = (1 - threshold) * len(shared) + 1e-5
        one = len({s for _, s, _ in shared}) == 1
        budget = int(lost * shared[0][1]) if one else lost
        others = [(k, size) for k, size, place in shared if place != at]
        large = a[1][p] * b[1][q] > LARGE if others else np.zeros(len(p), bool)
        for g, h in zip(p[large], q[large]):
            # too many to compare them all: one of the other kinds has to be near too
            rows = a[2][a[0][g] : a[0][g] + a[1][g]]
            more = None if own and g == h else b[2][b[0][h] : b[0][h] + b[1][h]]
            reach = {k: int(size * lost / len(others)) for k, size in others}
            for place, (k, size) in enumerate(others):
                used = range(words - -(-size // 64), words)
                x = [held[0][k][w][rows] for w in used]
                y = None if more is None else [held[-1][k][w][more] for w in used]
                for i, j, _ in near_indices(x, y, size, min(reach[k], size - 1)):
                    i, j = rows[i], (rows if more is None else more)[j]
                    for e, _ in others[:place]:
                        first = apart(held, e, i, j) > reach[e]
                        i, j = i[first], j[first]
                    yield from verified(n, held, at, shared, i, j)
        p, q = p[~large], q[~large]
        for pair, s, t in products(a[1][p], b[1][q], HELD):
            i, j = a[2][a[0][p[pair]] + s], b[2][b[0][q[pair]] + t]
            if own:
                # every row beside itself and every pair of one group twice
                keep = (p[pair] != q[pair]) | (i < j)
                i, j = i[keep], j[keep]
            spent = None
            for k, size, _ in sorted(shared, key=lambda x: x[2] != at):
                for w in range(words - -(-size // 64), words):
                    more = np.bitwise_count(held[0][k][w][i] ^ held[-1][k][w][j])
                    more = more.astype(np.int32) if one else more / size
                    spent = more if spent is None else spent + more
                keep = spent <= budget
                i, j, spent = i[keep], j[keep], spent[keep]
            yield from verified(n, held, at, shared, i, j)

    def apart(held: list, k: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(held[0][k][w][i] ^ held[-1][k][w][j]).astype(np.int32) for w in range(words))

    def verified(n: list, held: list, at: int, shared: list, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, fresh = np.zeros(len(i)), np.ones(len(i), bool)
        for k, size, place in shared:
            span = apart(held, k, i, j)
            total = total + (1 - span / size)
            if place < at:
                fresh &= span > most[sizes.index(size)]
        value = total / len(shared)
        fresh &= value.astype(np.float32) >= np.float32(threshold) if single else value >= threshold
        x, y = n[0][i[fresh]], n[-1][j[fresh]]
        if len(x):
            yield from batches({"x": np.minimum(x, y), "y": np.maximum(x, y), "similarity": value[fresh]})

    return compare


class Videos:
    """Rows (path, words) of a cell in the order of their paths; ``words`` has the frames one after the other."""

    def __init__(self, table: pa.Table, words: int, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        self.rank = rank[order]
        table = table.take(pa.array(order))
        self.paths = table["path"].combine_chunks()
        lists = table["words"].combine_chunks()
        self.counts = pa.compute.list_value_length(lists).to_numpy() // words
        flat = lists.flatten().to_numpy().view(np.uint64).reshape(-1, words)
        self.words = [np.ascontiguousarray(flat[:, w]) for w in range(words)]
        self.begin = np.cumsum(self.counts) - self.counts

    def frames(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct frames, and the distinct (frame, video) as two columns, by frame."""
        heads, order, _, size = groups_of(*self.words)
        frame = np.repeat(np.arange(len(heads)), size)
        video = np.repeat(np.arange(len(self.counts)), self.counts)[order]
        both = np.unique(frame * len(self.counts) + video)
        return [w[heads] for w in self.words], both // len(self.counts), both % len(self.counts)


def video_pairs(bits: int, threshold: float, most: int | None, first: float | None, directed: bool, squared: bool) -> Callable:
    """Comparison of cells of (path, words): (src, dst, similarity).

    ``most``: only videos of which some frames are within that distance, None for all.
    ``first``: the least similarity of the first frames, or None.
    """
    words = -(-bits // 64)
    whole = bits * bits if squared else bits

    def compare(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        if right is None or not len(left) or not len(right):
            return
        paths = [t["path"].to_numpy() for t in (left, right)]
        rank = np.unique(np.concatenate(paths), return_inverse=True)[1]
        x, y = Videos(left, words, rank[: len(left)]), Videos(right, words, rank[len(left) :])
        met = None if most is None else meeting(x, y)
        held: list[tuple] = []
        size = 0
        for s in range(len(x.counts)):
            if met is None:
                d = np.arange(len(y.counts))
            else:
                d = met(s)
            d = d[y.rank[d] != x.rank[s]] if directed else d[y.rank[d] > x.rank[s]]
            if first is not None:
                a = x.begin[s]
                apart = sum(np.bitwise_count(w[y.begin[d]] ^ v[a]).astype(np.int32) for v, w in zip(x.words, y.words))
                d = d[1 - apart / bits >= first]
            for p in range(0, len(d), 5_000):
                some = d[p : p + 5_000]
                total = similarity(x, s, y, some)
                keep = total >= threshold
                if keep.any():
                    held.append((np.full(int(keep.sum()), s), some[keep], total[keep]))
                    size += len(held[-1][0])
            if size > HELD:
                yield from result(x, y, held)
                held, size = [], 0
        if held:
            yield from result(x, y, held)

    def result(x: Videos, y: Videos, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        s, d, total = (np.concatenate(c) for c in zip(*held))
        yield from batches({"src": x.paths.take(pa.array(s)), "dst": y.paths.take(pa.array(d)), "similarity": total})

    def similarity(x: Videos, s: int, y: Videos, d: np.ndarray) -> np.ndarray:
        """Mean over the frames of s of their best similarity to a frame of each of d, summed in the order of the frames."""
        owner, place = spread(y.counts[d])
        at = y.begin[d][owner] + place
        own = [w[at] for w in y.words]
        starts = np.cumsum(y.counts[d]) - y.counts[d]
        total = np.zeros(len(d))
        for f in range(x.begin[s], x.begin[s] + x.counts[s]):
            apart = np.bitwise_count(own[0] ^ x.words[0][f]).astype(np.int16)
            for w in range(1, words):
                apart += np.bitwise_count(own[w] ^ x.words[w][f])
            total = total + np.maximum(0.0, 1 - np.minimum.reduceat(apart, starts) / whole)
        return total / x.counts[s]

    def meeting(x: Videos, y: Videos) -> Callable[[int], np.ndarray]:
        """For a video of x, the videos of y that have a frame near one of its frames."""
        (u, uf, uv), (v, vf, vv) = x.frames(), y.frames()
        near = list(near_indices(u, v, bits, most))
        i, j = (np.concatenate([n[k] for n in near]) if near else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        by_video = np.argsort(uv, kind="stable")
        frames, first = uf[by_video], np.searchsorted(uv[by_video], np.arange(len(x.counts) + 1))
        a, b = np.searchsorted(i, np.arange(len(u[0]))), np.searchsorted(i, np.arange(len(u[0])), "right")
        c, e = np.searchsorted(vf, np.arange(len(v[0]))), np.searchsorted(vf, np.arange(len(v[0])), "right")

        def met(s: int) -> np.ndarray:
            found = [vv[c[g] : e[g]] for f in frames[first[s] : first[s + 1]] for g in j[a[f] : b[f]]]
            if not found:
                return np.zeros(0, np.int64)
            mark = np.zeros(len(y.counts), bool)
            for n in found:
                mark[n] = True
            return np.flatnonzero(mark)

        return met

    return compare

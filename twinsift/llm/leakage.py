"""Evaluation passages leaking into training text: BM25 retrieval with block-max bounds, then exact overlap.

The index holds the test items: for every token the items it occurs in with their
BM25 impacts, in blocks of item numbers with the largest impact of each block.
Every 13-token passage of every document is a query.  An item's threshold is the
least BM25 score of any 13 consecutive tokens of its own (of all its tokens where
they are fewer), so an item that shares such a run scores at least its threshold:
retrieval loses nothing.  Impacts are divided by the threshold of their item, which
makes it 1 for all, and allows the bounds of WAND: a passage whose tokens' largest
impacts sum to less than 1, or with a token no item has, is skipped whole, then blocks by their block maxima, then
items by their score.  What is left is compared token by token.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm import bytescan

RUN = 13
#: Passages queried together: a query of this many tokens holds every run of RUN that begins in its first QUERY - RUN + 1 tokens.
QUERY = 24
BLOCK = 16
#: Items per index (some 20 MB), and indexes that one pass over the documents searches.
INDEX_ITEMS = 20_000
PASS_INDEXES = 8
ROUNDING = 1e-6
TOKEN_PATTERN = re.compile(r"[A-Za-z0-9_]+")


@dataclass
class ItemIndex:
    items: np.ndarray  # item ids by item number
    grams: list[list[str]]  # distinct token sequences of the items
    token_hash: np.ndarray  # sorted; the position is the token number
    best: np.ndarray  # largest normalised impact of each token
    best_by_run: dict[int, np.ndarray]  # the same among the items of each run length
    post_begin: np.ndarray  # per token: its range of (block) postings
    post_block: np.ndarray  # block number of each posting
    post_peak: np.ndarray  # largest impact in it
    post_row: np.ndarray  # (postings, BLOCK) impacts
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # run length -> sorted run hashes over token numbers, item numbers


def item_tokens(passage: str | None) -> list[str]:
    return [t.lower() for t in TOKEN_PATTERN.findall(passage or "")]


def hash_tokens(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
    return bytescan.range_hashes(data, np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64)) if words else np.zeros(0, np.uint64)


def build_index(rows: list[tuple[int, str | None]], k1: float = 1.2, b: float = 0.75) -> ItemIndex | None:
    """The index of (item id, passage) rows; items without tokens are left out, None if none is left."""
    pairs = [(i, t) for i, t in ((i, item_tokens(p)) for i, p in sorted(rows, key=lambda r: (r[0], r[1] or ""))) if t]
    if not pairs:
        return None
    words = sorted({w for _, t in pairs for w in t})
    hashes = hash_tokens(words)
    order = np.argsort(hashes)
    number = {words[j]: n for n, j in enumerate(order)}
    held = Counter(w for _, t in pairs for w in set(t))
    mean = sum(len(t) for _, t in pairs) / len(pairs)
    idf = {w: math.log(1 + (len(pairs) - n + 0.5) / (n + 0.5)) for w, n in held.items()}
    postings: dict[tuple[int, int], np.ndarray] = {}
    runs: dict[int, list[tuple[int, int]]] = {}
    for slot, (_, toks) in enumerate(pairs):
        counts = Counter(toks)
        norm = k1 * (1 - b + b * len(toks) / mean)
        weight = {w: idf[w] * c * (k1 + 1) / (c + norm) for w, c in counts.items()}
        length = min(RUN, len(toks))
        least = min(sum(weight[w] for w in set(toks[s : s + length])) for s in range(len(toks) - length + 1))
        for w, x in weight.items():
            row = postings.setdefault((number[w], slot // BLOCK), np.zeros(BLOCK))
            row[slot % BLOCK] = x / least
        codes = np.array([number[w] for w in toks], np.int64)
        begin = np.arange(len(toks) - length + 1)
        runs.setdefault(length, []).extend((int(h), slot) for h in bytescan.range_hashes(codes, begin, begin + length))
    keys = sorted(postings)
    table = np.array([postings[k] for k in keys])
    tokens_of = np.array([k[0] for k in keys])
    peak = table.max(axis=1)
    begin = np.searchsorted(tokens_of, np.arange(len(words) + 1))
    packed, by_run = {}, {}
    for length, found in runs.items():
        slots = np.zeros(-(-len(pairs) // BLOCK) * BLOCK, bool)
        slots[[x for _, x in found]] = True
        own = np.where(slots.reshape(-1, BLOCK)[[k[1] for k in keys]], table, 0.0).max(axis=1)
        by_run[length] = np.maximum.reduceat(own, begin[:-1])
        h = np.array([x for x, _ in found], np.uint64)
        s = np.array([x for _, x in found], np.int64)
        by = np.argsort(h, kind="stable")
        packed[length] = h[by], s[by]
    return ItemIndex(
        np.array([i for i, _ in pairs]), [t for _, t in pairs], hashes[order], np.maximum.reduceat(peak, begin[:-1]), by_run, begin,
        np.array([k[1] for k in keys]), peak, table, packed,
    )


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes laid end to end: the range of each place, and the place within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def retrieve(index: ItemIndex, query: np.ndarray, token: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item number, score) of every item whose normalised score reaches 1, given distinct (query, token) pairs sorted by query."""
    floor = 1 - ROUNDING
    best = index.best[token]
    # essential tokens: those not among the weakest whose bounds together stay below the threshold
    order = np.lexsort((best, query))
    running = np.cumsum(best[order])
    begin = np.searchsorted(query[order], np.arange(queries))
    before = np.r_[0.0, running][begin]
    essential = np.zeros(len(query), bool)
    essential[order] = running - before[query[order]] >= floor
    eq, et = query[essential], token[essential]
    counts = index.post_begin[et + 1] - index.post_begin[et]
    owner, step = spread(counts)
    key = np.unique(eq[owner] * np.int64(1 << 32) + index.post_block[index.post_begin[et][owner] + step])
    cq, block = key >> 32, key & 0xFFFFFFFF
    # block bounds over all tokens of the query
    ends = np.searchsorted(query, np.arange(queries + 1))
    pair, step = spread(ends[cq + 1] - ends[cq])
    toks = token[ends[cq][pair] + step]
    place = find_postings(index, toks, block[pair])
    hit = place >= 0
    pair, place = pair[hit], place[hit]
    keep = np.bincount(pair, index.post_peak[place], minlength=len(cq)) >= floor
    use = keep[pair]
    renumber = np.cumsum(keep) - 1
    pair, place = renumber[pair[use]], place[use]
    cq, block = cq[keep], block[keep]
    score = np.zeros((len(cq), BLOCK))
    if len(pair):
        at = np.searchsorted(pair, np.arange(len(cq)))
        score = np.add.reduceat(index.post_row[place], at, axis=0)
    row, col = np.nonzero(score >= floor)
    return cq[row], block[row] * BLOCK + col, score[row, col]


def find_postings(index: ItemIndex, token: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Position of the posting of (token, block), -1 where there is none."""
    keys = index_keys(index)
    want = token.astype(np.int64) << 32 | block.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def index_keys(index: ItemIndex) -> np.ndarray:
    keys = getattr(index, "_keys", None)
    if keys is None:
        tokens_of = np.repeat(np.arange(len(index.post_begin) - 1), np.diff(index.post_begin))
        keys = index._keys = tokens_of.astype(np.int64) << 32 | index.post_block.astype(np.int64)
    return keys


def scan(index: ItemIndex, data: np.ndarray, offsets: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, float, int]]:
    """(text, item number, best score, runs shared) of the texts of one buffer, given its tokens."""
    begin, end, hashes = tokens
    if not len(begin):
        return []
    at = np.minimum(np.searchsorted(index.token_hash, hashes), len(index.token_hash) - 1)
    known = index.token_hash[at] == hashes
    code = np.where(known, at, -1)
    text = bytescan.text_of(begin, offsets)
    count = len(code)
    # a passage is alive if a run of its first tokens could reach an item: all of them indexed, and their bounds sum to the threshold
    text_end = np.searchsorted(text, text, side="right")
    indexed = np.r_[0, np.cumsum(known)]
    alive = np.zeros(count, bool)
    for length, best in index.best_by_run.items():
        stop = np.arange(count) + length
        fits = stop <= text_end
        stop = np.minimum(stop, count)
        total = np.r_[0.0, np.cumsum(np.where(known, best[at], 0.0))]
        alive |= fits & (indexed[stop] - indexed[:-1] == length) & (total[stop] - total[:-1] >= 1 - ROUNDING)
    if not alive.any():
        return []
    # live passages in groups of QUERY - RUN + 1 neighbouring beginnings, one query each
    first = np.searchsorted(text, text)
    group = (np.arange(count) - first) // (QUERY - RUN + 1)
    lead = np.nonzero(alive)[0]
    heads = np.unique(first[lead] + group[lead] * (QUERY - RUN + 1))
    tails = np.minimum(heads + QUERY, text_end[heads])
    found: dict[tuple[int, int], tuple[float, int]] = {}
    for a in range(0, len(heads), 20_000):
        h, t = heads[a : a + 20_000], tails[a : a + 20_000]
        owner, step = spread(t - h)
        codes = code[h[owner] + step]
        pair = np.unique(owner[codes >= 0].astype(np.int64) << 32 | codes[codes >= 0])
        q, item, score = retrieve(index, pair >> 32, pair & 0xFFFFFFFF, len(h))
        for length, (run_hash, run_item) in index.runs.items():
            # candidates of items with runs of this length, at every beginning of their query
            owns = np.isin(item, run_item)
            cq, ci, cs = q[owns], item[owns], score[owns]
            if not len(cq):
                continue
            # later beginnings of short runs belong to the next query
            owner, step = spread(np.clip(t[cq] - h[cq] - length + 1, 0, QUERY - RUN + 1))
            place = h[cq][owner] + step
            value = bytescan.range_hashes(code, place, place + length)
            lo, hi = np.searchsorted(run_hash, value), np.searchsorted(run_hash, value, side="right")
            hit = np.nonzero(hi > lo)[0]
            for i in hit:
                slot = ci[owner[i]]
                if slot not in run_item[lo[i] : hi[i]]:
                    continue
                run = [data[begin[j] : end[j]].tobytes().decode().lower() for j in range(place[i], place[i] + length)]
                toks = index.grams[slot]
                if any(toks[s : s + length] == run for s in range(len(toks) - length + 1)):
                    key = int(text[place[i]]), int(slot)
                    best, shared = found.get(key, (0.0, 0))
                    found[key] = max(best, float(cs[owner[i]])), shared + 1
    return [(*k, *v) for k, v in found.items()]


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, shared_runs): every document with 13 consecutive tokens of an item, or all tokens of a shorter item.

    Tokens are maximal runs of ASCII letters, digits and ``_``, lower-cased.
    ``score`` is the largest BM25 score of a matching passage relative to the item's
    threshold, ``shared_runs`` the number of places that match.  Null or tokenless
    texts and items match nothing; items with equal passages are all reported, as
    are repeated documents.  Items beyond ``index_items`` go to further indexes, so
    the broadcasts of a pass stay bounded; a pass tokenises the documents once for PASS_INDEXES indexes.
    """
    spark = docs.sparkSession
    rows = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    parts = max(1, -(-rows.count() // index_items))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    result: DataFrame | None = None
    for first_part in range(0, parts, PASS_INDEXES):
        held = []
        for k in range(first_part, min(parts, first_part + PASS_INDEXES)):
            part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
            index = build_index([(r[0], r[1]) for r in part.collect()])
            if index is not None:
                held.append(spark.sparkContext.broadcast(index))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            indexes = [b.value for b in held]
            for batch in batches if indexes else ():
                out: list[tuple[int, int, float, int]] = []
                for first, _, data, offsets in bytescan.chunks(batch.column(1)):
                    tokens = bytescan.tokens(data, offsets)
                    for index in indexes:
                        out += [(first + t, int(index.items[i]), s, n) for t, i, s, n in scan(index, data, offsets, tokens)]
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in out], pa.int64())), *[pa.array([r[c] for r in out], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]],
                    names=["doc_id", "item_id", "score", "shared_runs"],
                )

        found = narrow.mapInArrow(run, "doc_id long, item_id long, score double, shared_runs long")
        result = found if result is None else result.unionByName(found)
    return result

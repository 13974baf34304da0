"""Filling containers of fixed token capacity: shortest-pack-first over the length histogram.

Documents longer than a container are cut into full pieces and a rest; any other is
one piece.  Only the histogram of piece lengths, at most ``capacity`` numbers, goes
to the driver.  There lengths are placed longest first, all pieces of a length at
once, each into the pack with most room; packs of equal content are one pattern with
a count.  Pieces then find their container by rank among the pieces of their length,
which is computed in salted parts so that a common length does not fill one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinsift.llm.shared import Workspace

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RANK_ROWS = 500_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) per row; a null text has 0 tokens, special tokens in a text are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoder(tokenizer).encode_ordinary
            counts = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, times), ...]) that hold exactly the pieces of the histogram.

    Lengths run from the longest; each goes to the packs with most room, as long as
    these have most, and opens new packs where none has room.
    """
    room: dict[int, list[list]] = {}
    largest: list[int] = []  # heap of minus room

    def put(space: int, count: int, content: list[tuple[int, int]]) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(largest, -space)
        room[space].append([count, content])

    for length in sorted((n for n in histogram if 0 < n <= capacity), reverse=True):
        left = histogram[length]
        while left:
            space = -largest[0] if largest else 0
            if space < length:
                # as many of the length per new pack as fit: the packs stay the emptiest until full
                per = capacity // length
                packs, rest = divmod(left, per)
                if packs:
                    put(capacity - per * length, packs, [(length, per)])
                if rest:
                    put(capacity - rest * length, 1, [(length, rest)])
                break
            packs = room[space]
            count, content = packs.pop()
            if not packs:
                del room[space]
                heapq.heappop(largest)
            second = -largest[0] if largest else 0
            times = max(1, min(space // length, -(-(space - second) // length)))
            if left < times * count:
                times = max(1, min(times, left // count))
            use = min(count, left // times)
            if use < count:
                put(space, count - use, content)
            put(space - times * length, use, [*content, (length, times)])
            left -= use * times
    return [(count, content) for space in sorted(room) for count, content in room[space]]


def pack_documents(lengths: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(doc_id, piece_no, container_id, offset_in_container, start_token, n_tokens) for every piece of (doc_id, n_tokens).

    A document of up to ``capacity`` tokens is one piece, number 0; a longer one is
    cut into full pieces and a rest.  Containers are numbered from 0 without gaps,
    and hold pieces of ``capacity`` tokens or fewer together.  Documents without
    tokens, or of null length, are one piece of length 0 in no container (null).
    Rows with the same id are packed apart.  Empty input gives no rows.
    """
    spark = lengths.sparkSession
    work = Workspace(spark, "packing")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    cuts = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("long")
    pieces = lengths.select("doc_id", n.alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("piece_no"))
    pieces = pieces.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))
    pieces = work.save(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for count, content in pack_histogram(histogram, capacity):
        offset = 0
        for length, times in content:
            start = taken.get(length, 0)
            slots.append((length, start, start + times * count, times, base, offset))
            taken[length] = start + times * count
            offset += length * times
        base += count
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "low", "high", "times", "base", "at")])
    places = spark.createDataFrame(slots, schema)

    parts = max(1, -(-max(histogram.values(), default=0) // rank_rows))
    salted = pieces.where("n_tokens > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("n_tokens", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece_no")) - 1
    # capacity * parts rows, and as many patterns as lengths and splits: small beside the pieces
    ranked = salted.withColumn("inside", inside).join(F.broadcast(sizes) if capacity * parts <= 100_000 else sizes, ["n_tokens", "part"])
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("before"))
    held = ranked.join(
        F.broadcast(places) if len(slots) <= 200_000 else places, (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    turn = F.col("rank") - F.col("low")
    placed = held.select(
        "doc_id", "piece_no", (F.col("base") + F.floor(turn / F.col("times"))).cast("long").alias("container_id"),
        (F.col("at") + F.pmod(turn, F.col("times")) * F.col("length")).cast("long").alias("offset_in_container"), "start_token", "n_tokens",
    )
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece_no", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("offset_in_container"), "start_token", "n_tokens")
    return placed.unionByName(none)


def pack_texts(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`pack_documents` of texts; every text is tokenized once and whole."""
    work = Workspace(df.sparkSession, "tokens")
    return pack_documents(work.save(token_counts(df, id_col, text_col, tokenizer), "lengths"), capacity)

"""Most similar vectors for every vector: sharded HNSW over binary vectors.

Vectors are split into shards by a few of their bits, once per routing table, so
that close vectors meet in a shard of at least one table with known probability.
Each shard is one graph of :mod:`twinsift.llm.hnsw`; the k best per vector of all
shards are merged.  The number of tables follows from the number of shards (and
so from the data), not from a fixed setting.  A shard that came out far larger than
planned is routed again as a collection of its own, with tables of its own; what is
still too large after that is cut into blocks, every two of which are one shard.  So
no pair is given up as data grows, and no shard is one unbounded task.

Equal vectors are one node.  A class of copies, however large, costs one insertion
and its members take the smallest ids of the class as neighbours.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.hnsw import near_pairs
from twinsift.llm.shared import Workspace, usable_hash
from twinsift.operators.skew import join_heads


def plan_tables(count: int, reach: int, dims: int, shard_rows: int, meet: float) -> tuple[int, int]:
    """(bits of a shard key, number of tables): pairs at distance ``reach`` meet with probability ``meet`` or more."""
    bits = max(0, round(math.log2(max(count, 1) / shard_rows)))
    if bits == 0:
        return 0, 1
    together = (1 - reach / dims) ** bits
    return bits, max(1, math.ceil(math.log(1 - meet) / math.log(1 - together)))


def vector_bit(position: int) -> Column:
    """Bit ``position`` of the binary column vec, the most significant of its first byte being 0."""
    byte = F.conv(F.hex(F.substring("vec", position // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, 7 - position % 8).bitwiseAND(F.lit(1)).cast("long")


def bit_key(positions: list[int]) -> Column:
    key: Column = F.lit(0).cast("long")
    for p in positions:
        key = key * 2 + vector_bit(p)
    return key


def telling_spans(classes: DataFrame, count: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The hashes to route by, as bit ranges of vec: those of many distinct values, the most first, or all bits as one if none has.

    A hash with one value in a large share of the vectors would put them all in one shard.
    """
    values = [F.approx_count_distinct(F.substring("vec", a // 8 + 1, (b - a) // 8)).alias(f"n{i}") for i, (a, b) in enumerate(spans)]
    found = sorted(zip(classes.agg(*values).first(), spans), key=lambda x: (-x[0], x[1]))
    return [s for n, s in found if 4 * n >= 3 * count] or [(spans[0][0], spans[-1][1])]


def sampled_bits(rng: random.Random, table: int, bits: int, spans: list[tuple[int, int]]) -> list[int]:
    """Bits of one hash per table, in turn: a pair far apart in one hash is close in the others."""
    turn = spans[table % len(spans) :] + spans[: table % len(spans)]
    found: list[int] = []
    for begin, end in turn:
        found += rng.sample(range(begin, end), min(end - begin, bits - len(found)))
    return found


def route(classes: DataFrame, work: Workspace, count: int, reach: int, spans: list[tuple[int, int]], shard_rows: int, meet: float) -> tuple[DataFrame, int, int]:
    """(shard, node, vec), a row per shard a node belongs to, the number of shards planned, and of tables."""
    dims = spans[-1][1]
    most = 3 * shard_rows
    rng = random.Random(11)
    spans = telling_spans(classes, count, spans)
    bits, tables = plan_tables(count, reach, dims, shard_rows, meet)
    keys = [bit_key(sampled_bits(rng, t, bits, spans)) for t in range(tables)]
    routed = classes.select("node", "vec", F.posexplode(F.array(*keys)).alias("tab", "key")).select(F.struct("tab", "key").alias("shard"), "node", "vec")
    if not bits:
        return routed.select(F.struct("shard").alias("shard"), "node", "vec"), 1, 1
    sizes = work.save(routed.groupBy("shard").count(), "shard-sizes")
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return routed.select(F.struct("shard").alias("shard"), "node", "vec"), tables * 2**bits, tables
    # again, with bits and tables by the size of the shard
    deepest, widest = plan_tables(largest, reach, dims, shard_rows, meet)
    again = F.array(*[bit_key(sampled_bits(rng, tables + t, deepest, spans)) for t in range(widest)])
    more = F.round(F.log2(F.col("count") / shard_rows)).cast("int")
    often = F.ceil(F.log(F.lit(1 - meet)) / F.log(1 - F.pow(F.lit(1 - reach / dims), more))).cast("int")
    plan = sizes.where(F.col("count") > most).select("shard", more.alias("more"), often.alias("often"))
    marked = routed.join(plan, "shard", "left")
    turns = F.explode(F.when(F.col("more").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("often") - 1))).alias("turn")
    deep = marked.select("shard", "node", "vec", "more", turns)
    sub = F.when(F.col("turn") >= 0, F.expr(f"shiftright(element_at(again, turn + 1), {deepest} - more)"))
    deep = deep.withColumn("again", F.when(F.col("turn") >= 0, again)).select(F.struct("shard", "turn", sub.alias("sub")).alias("shard"), "node", "vec")
    deep = work.save(deep, "routed")
    # what random bits do not split: every two of its blocks are a shard
    blocks = deep.groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(2 * F.col("count") / shard_rows).cast("int").alias("blocks"))
    cut = deep.join(blocks, "shard", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.expr("if(blocks is null, array(-1), filter(sequence(0, blocks - 1), x -> x <> block))")
    cut = cut.withColumn("other", F.explode(others))
    pair = F.struct("shard", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return cut.select(pair.alias("shard"), "node", "vec"), tables * 2**bits, tables


def best_per_node(ids: np.ndarray, left: np.ndarray, right: np.ndarray, span: np.ndarray, k: int) -> pd.DataFrame:
    """The k closest partners of each node, ties to the smaller id, out of pairs in any direction and repetition."""
    a = np.r_[ids[left], ids[right]]
    b = np.r_[ids[right], ids[left]]
    d = np.r_[span, span]
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, d = a[first], b[first], d[first]
    begin = np.searchsorted(a, a)
    keep = np.arange(len(a)) - begin < k
    return pd.DataFrame({"a": a[keep], "b": b[keep], "d": d[keep].astype(np.int32)})


def similar_vectors(
    df: DataFrame,
    id_col: str,
    hash_cols: list[str],
    k: int = 5,
    reach: int = 76,
    digits: int = 64,
    shard_rows: int = 8_000,
    meet: float = 0.93,
) -> DataFrame:
    """(id, neighbour, distance): the k nearest other records of each record within ``reach`` differing bits.

    The vector of a record is the concatenation of its ``hash_cols``, hex texts of
    ``digits`` digits.  Rows of one id are one record (the largest usable text of
    each hash counts); records without every hash usable, and null ids, have no
    row.  Beams grow with k.  Ties go to the smaller id.  Approximate: pairs that meet in no shard or
    that the walk misses are absent; nothing else is dropped, and distances are
    exact.  A pair at distance ``reach`` meets with probability ``meet`` or more, a closer
    one more often.  Empty input gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    work = Workspace(spark, "knn")
    names = [f"h{i}" for i in range(len(hash_cols))]
    clean = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), *[usable_hash(c, digits).alias(n) for c, n in zip(hash_cols, names)]
    )
    records = clean.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).dropna()
    records = work.save(records.select("id", F.unhex(F.concat(*names)).alias("vec")), "records")

    classes = work.save(records.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("members")), "classes")
    count = classes.count()
    spans = [(4 * digits * i, 4 * digits * (i + 1)) for i in range(len(hash_cols))]
    routed, shards, _ = route(classes, work, count, reach, spans, shard_rows, meet)

    def search(shard: pa.Table) -> pa.Table:
        ids = shard["node"].to_numpy()
        order = np.argsort(ids)
        rows = np.frombuffer(b"".join(shard["vec"].to_pylist()), dtype=">u8").reshape(len(ids), -1)[order].astype(np.uint64)
        return pa.Table.from_pandas(best_per_node(ids[order], *near_pairs(rows, ids[order], reach, k), k), preserve_index=False)

    # in Arrow, as in pandas the key of the shard is an object per row
    found = routed.repartition(max(3 * shards, 4), "shard").groupBy("shard").applyInArrow(search, "a long, b long, d int")
    found = work.save(found, "found").distinct()
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)

    # the k + 1 smallest members of every class; the limit acts before the shuffle, so a huge class sends k + 1 rows per task
    smallest = records.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    lists = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = work.save(classes.join(lists, "vec"), "lists")
    heads = lists.select(F.col("node").alias("b"), F.slice("ids", 1, k).alias("far"))
    around = ranked.join(heads, "b").groupBy("a").agg(F.collect_list(F.struct("d", "far")).alias("others"))
    # members beyond the k + 1 smallest only see their own class
    listed = lists.select("node", "members", "ids", F.explode("ids").alias("id"))
    own = listed.join(around, F.col("node") == F.col("a"), "left").select(
        "id",
        F.concat(
            F.transform(F.array_except("ids", F.array("id")), lambda x: F.struct(F.lit(0).alias("distance"), x.alias("neighbour"))),
            F.coalesce(
                F.flatten(F.transform("others", lambda o: F.transform(o["far"], lambda x: F.struct(o["d"].alias("distance"), x.alias("neighbour"))))),
                F.array().cast("array<struct<distance:int,neighbour:bigint>>"),
            ),
        ).alias("near"),
    )
    own = own.select("id", F.explode(F.slice(F.array_sort("near"), 1, k)).alias("n")).select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"))
    large = lists.where(F.col("members") > k + 1).select("vec", "ids", "members")
    rest = join_heads(records.select("id", "vec"), large, "vec", "ids", "members", records.count())
    rest = rest.where(~F.array_contains("ids", F.col("id"))).select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(0).alias("distance"))
    return own.unionByName(rest)


def neighbour_pairs(neighbours: DataFrame, a: str = "image_id_a", b: str = "image_id_b") -> DataFrame:
    """One row per unordered pair of which at least one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias(a), F.greatest("id", "neighbour").alias(b)).distinct()

"""Consolidating pairwise matches into groups: connected components by merging spanning forests.

Every round cuts the edges into partitions of bounded size.  Union-find inside a
partition keeps a spanning forest, as links from each node to the root of its tree.
A node with roots in several partitions ties those roots together; these ties, over
roots only, are the edges of the next round.  Once few enough are left, one bounded
partition finishes them.  Labels are then composed backwards through the rounds.

An edge goes to the partition of the endpoint of smaller rank, a hash that changes
by round, so that a constant share of nodes meets all its neighbours and disappears
in every round: chains of any length take a logarithmic number of rounds.  Edges of
a node with more than a partition's worth of them are spread by the other endpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.shared import Workspace
from twinsift.operators.skew import join_heads

#: Edges of one partition: some 50 MB of a Python worker.
PART_EDGES = 100_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges a - b; the root is the smallest node of its tree."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    left, right = place[: len(a)].tolist(), place[len(a) :].tolist()
    parent = list(range(len(nodes)))
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.array(parent, np.int64)
    while True:
        up = roots[roots]
        if (up == roots).all():
            break
        roots = up
    return nodes, nodes[roots]


def forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forest of one partition of (a, b) rows."""
    whole = list(parts)
    if whole:
        edges = pd.concat(whole, ignore_index=True)
        node, root = forest(edges["a"].to_numpy(), edges["b"].to_numpy())
        yield pd.DataFrame({"node": node, "root": root})


def component_roots(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) of every node of the edges (a, b), bigint; root is some node of the component, the same for all of it."""
    work = Workspace(edges.sparkSession, "components")
    edges = work.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    count = edges.count()
    steps: list[DataFrame] = []
    turn = 0
    while True:
        turn += 1
        if count <= part_edges:
            final = work.save(edges.coalesce(1).mapInPandas(forests, "node long, root long"), f"last-{turn}")
            break
        rank = [F.xxhash64(F.col(c), F.lit(turn)) for c in "ab"]
        low, high = F.when(rank[0] <= rank[1], F.col("a")).otherwise(F.col("b")), F.when(rank[0] <= rank[1], F.col("b")).otherwise(F.col("a"))
        aimed = edges.select("a", "b", low.alias("low"), high.alias("high"))
        # at most count / part_edges nodes hold more edges than a partition
        hot = aimed.groupBy("low").count().where(F.col("count") > part_edges // 4).select("low", F.lit(True).alias("hot"))
        parts = -(-count // part_edges) * 2
        spread = aimed.join(F.broadcast(hot) if count // part_edges < 100_000 else hot, "low", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("high"), F.lit(parts))).otherwise(0))
        trees = spread.repartition(parts, "low", "salt").select("a", "b").mapInPandas(forests, "node long, root long")
        trees = work.save(trees, f"trees-{turn}")
        chosen = trees.groupBy("node").agg(F.min(F.struct(F.xxhash64("root", F.lit(turn)).alias("rank"), "root")).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        chosen = work.save(chosen.select("node", F.col("m.root").alias("root"), (F.col("low") != F.col("high")).alias("several")), f"step-{turn}")
        steps.append(chosen.select("node", "root"))
        ties = trees.withColumnRenamed("root", "other").join(chosen.where("several"), "node").where("root <> other")
        edges = work.save(ties.select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b")).distinct(), f"edges-{turn}")
        work.drop(f"edges-{turn - 1}", f"trees-{turn}")
        before, count = count, edges.count()
        if count >= before:
            # a round over random ranks contracts; cut wider rather than go on for ever where it did not
            part_edges *= 2
    labels = final
    for k, step in reversed(list(enumerate(steps))):
        # a node's label is that of its root, or the root itself where no later round saw it; the few roots of very many nodes go apart
        sizes = work.save(step.groupBy("root").agg(F.count("*").alias("n")), f"sizes-{k}")
        tops = sizes.join(labels.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("root", F.coalesce("top", "root").alias("top"), "n")
        labels = work.save(join_heads(step, tops, "root", "top", "n", step.count()).select("node", F.col("top").alias("root")), f"labels-{k}")
        work.drop(f"sizes-{k}")
    return labels


def linked_groups(edges: DataFrame, src: str = "src", dst: str = "dst", part_edges: int = PART_EDGES) -> DataFrame:
    """(path, group_key): every path on an edge with the smallest path connected to it, itself included.

    Paths compare by bytes.  Direction and repetition do not matter; edges from a
    path to itself and edges with a null end are ignored, and a path only on such
    edges has no row.  No edges give no rows.  Other columns are ignored.
    """
    work = Workspace(edges.sparkSession, "groups")
    pairs = edges.select(F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("d")).where("s is not null and d is not null and s <> d")
    pairs = work.save(pairs.distinct(), "pairs")
    for seed in range(100):  # 64-bit names for paths; a clash shows as two paths of one name and takes another seed
        s, d = F.xxhash64("s", F.lit(seed)), F.xxhash64("d", F.lit(seed))
        ends = pairs.select(s.alias("node"), F.col("s").alias("path")).unionByName(pairs.select(d.alias("node"), F.col("d").alias("path")))
        nodes = work.save(ends.groupBy("node").agg(F.min("path").alias("path"), F.max("path").alias("last")), f"nodes-{seed}")
        if nodes.where("path <> last").isEmpty():
            break
    roots = component_roots(pairs.select(s.alias("a"), d.alias("b")), part_edges)
    named = work.save(roots.join(nodes.select("node", "path"), "node").select("root", "path"), "named")
    keys = work.save(named.groupBy("root").agg(F.min("path").alias("group_key"), F.count("*").alias("n")), "keys")
    return join_heads(named, keys, "root", "group_key", "n", named.count()).select("path", "group_key")


def counting_edges(edges: DataFrame, least: float = 0.85) -> DataFrame:
    """Edges whose similarity is a number of ``least`` or more."""
    return edges.where(F.col("similarity").isNotNull() & ~F.isnan("similarity") & (F.col("similarity") >= least))

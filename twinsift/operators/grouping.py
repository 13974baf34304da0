"""First-come grouping of similarity edges: a deterministic star clustering.

Nodes are taken in ascending order.  A node with an earlier leader among its
neighbours joins the earliest such leader; any other node is a leader.  The
leaders are the lexicographically first maximal independent set of the graph, so
the result depends on the edges and the order alone, not on how it is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.plans.workspace import Workspace

#: Edge lists up to this length are resolved by one task (some 100 MB); longer ones by distributed rounds.
ONE_TASK_EDGES = 1_000_000


def first_come(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, leader) of every node that joins a leader, from edges (a, b) with a < b."""
    leader: dict = {}
    for a, b in edges.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
        # by ascending a: whether a is a member is settled before its own edges are read
        if a not in leader and b not in leader:
            leader[b] = a
    return pd.DataFrame({"node": pd.Series(list(leader.keys()), dtype=edges["a"].dtype), "leader": pd.Series(list(leader.values()), dtype=edges["a"].dtype)})


def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, leads) of the nodes b whose part in the grouping follows from edges (a, b, leads) in the order of (b, a).

    ``leads`` tells whether a is known to be a leader, or nothing where a is undecided.
    A node with a leader before it is a member; one with members only before it, whose
    edges have gone, or with nodes decided here, is a leader.  Only decisions are held.
    """
    known: dict = {}
    node, waits, joins = None, False, False

    def settle() -> None:
        if node is not None and (joins or not waits):
            known[node] = not joins

    for batch in parts:
        for a, b, leads in zip(batch["a"], batch["b"], batch["leads"]):
            if b != node:
                settle()
                node, waits, joins = b, False, False
            if leads is None or leads != leads:
                leads = known.get(a)
            if leads:
                joins = True
            elif leads is None:
                waits = True
    settle()
    yield pd.DataFrame({"node": pd.Series(list(known.keys())), "leads": pd.Series(list(known.values()), dtype=object)})


def assign_leaders(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES, edges_at_most: int | None = None) -> DataFrame:
    """(node, leader) for every node that is not a leader itself.

    ``edges`` is (a, b); direction, repetition, loops and nulls do not matter.  No
    edges give no rows.  Above ``one_task_edges`` the leaders are found in rounds over
    written tables.  Edges are cut into ranges of b of about ``one_task_edges``; a round
    decides what follows inside each range, so it decides at least the first range
    still open: chains of any length take no more rounds than there are ranges.
    ``edges_at_most`` is a bound the caller knows; it saves counting.
    """
    work = Workspace(edges.sparkSession, "grouping")
    kind = edges.schema["a"].dataType.simpleString()
    clean = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(parts)
        if whole:
            yield first_come(pd.concat(whole, ignore_index=True))

    schema = f"node {kind}, leader {kind}"
    if edges_at_most is not None and edges_at_most <= one_task_edges:
        return clean.coalesce(1).mapInPandas(run, schema)
    every = work.save(clean, "edges-0")
    count = every.count()
    if count <= one_task_edges:
        return every.coalesce(1).mapInPandas(run, schema)
    # nodes with no earlier neighbour lead
    first = every.select(F.col("a").alias("node")).distinct().join(every.select(F.col("b").alias("node")), "node", "left_anti")
    status = work.save(first.withColumn("leads", F.lit(True)), "decided-0")
    left, turn = every, 0
    while count:
        turn += 1
        ends = status.withColumnRenamed("node", "a")
        marked = left.drop("leads").join(ends, "a", "left") if turn == 1 else left.join(ends.withColumnRenamed("leads", "now"), "a", "left").select("a", "b", F.coalesce("leads", "now").alias("leads"))
        # members neither lead nor block
        marked = work.save(marked.where("leads is null or leads"), f"marked-{turn}")
        ranges = -(-count // max(1, one_task_edges))
        # a node all of whose earlier neighbours are members has lost its edges: it leads
        freed = left.select(F.col("b").alias("node")).distinct().join(marked.select(F.col("b").alias("node")), "node", "left_anti").withColumn("leads", F.lit(True))
        ordered = marked.repartitionByRange(ranges, "b").sortWithinPartitions("b", "a")
        status = work.save(ordered.mapInPandas(decide, f"node {kind}, leads boolean").unionByName(freed), f"decided-{turn}")
        left = work.save(marked.join(status.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b", "leads"), f"edges-{turn}")
        count = left.count()
        work.drop(f"marked-{turn}", *([f"edges-{turn - 1}"] if turn > 1 else []))
    decided = work.read_all("decided-*", status)
    leaders = decided.where("leads").select(F.col("node").alias("a"))
    members = decided.where("not leads").select(F.col("node").alias("b"))
    return every.join(members, "b", "left_semi").join(leaders, "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))


def greedy_groups(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(leader, path, similarity): every group of two or more, its leader included with similarity 1.0.

    ``edges`` is (src, dst, similarity); a member shows its similarity to the leader
    (the largest where an edge is repeated).
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "similarity")
    assigned = assign_leaders(pairs.select("a", "b"), one_task_edges)
    best = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    members = assigned.join(best, (F.col("a") == F.col("leader")) & (F.col("b") == F.col("node"))).select("leader", F.col("node").alias("path"), "similarity")
    heads = members.select("leader").distinct().select("leader", F.col("leader").alias("path"), F.lit(1.0).alias("similarity"))
    return members.unionByName(heads)

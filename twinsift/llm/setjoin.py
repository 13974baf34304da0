"""All similar pairs between set-valued records, by metric pivot partitioning.

Under Jaccard distance, with ``reach`` = 1 - the overlap asked for, every record has a
pivot within reach / 2: pivots are a net of the records, each of which names the
nearest pivot as its home, and a record with no pivot that near is a pivot itself.  By
the triangle inequality a record within reach of one at home in a cell lies within the
cell's radius plus reach of the pivot; it is replicated into every such cell.  Home
records are joined exactly with all records of their cell: two at distances r and s from
the pivot are similar if r + s <= reach and not if |r - s| > reach, whatever their
elements; only pairs in between are compared.

Most pairs of sparse sets are at distance 1, so pivots cannot be drawn at random and
compared with all.  Distances to pivots are taken where two sets have a witness in
common, an element (or combination) of which sets that overlap enough share one:

- in any order of the elements, one of the first size - overlap + 1;
- frequent ("hot") elements come last in the order and witness nothing alone: sets that
  share only hot witnesses share two of them, and three where the pair is frequent too.

Equal sets are one class.  Cells over a size limit are joined in blocks, so no task
sees more than two blocks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.shared import Workspace, usable_set
from twinsift.operators.similarity import between_values
from twinsift.operators.skew import join_heads

CELL_BLOCK = 2_000
HOT_SHARE = 20_000
#: Distances are quotients of small integers: this is far below any difference between two.
ROUNDING = 1e-9


def record_sets(df: DataFrame, id_col: str, set_col: str, least: int = 3) -> DataFrame:
    """(id, items): one row per id with its distinct usable elements, sorted; ids with fewer than ``least`` are left out.

    Of several rows of one id the elements are united, so redelivered copies change nothing.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.array_sort(usable_set(set_col)).alias("items")).distinct()
    one = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return one.where(F.size("items") >= least)


def overlap_reaches(shared: Column, left: Column, right: Column, least: Fraction) -> Column:
    """shared / union >= least, in integers."""
    return shared * least.denominator >= (left + right - shared) * least.numerator


def least_overlap(size: Column, least: Fraction, smallest: int = 1) -> Column:
    """The fewest elements that a set of this size shares with a similar one of ``smallest`` elements or more."""
    num, den = least.numerator, least.denominator
    other = F.greatest(F.lit(smallest), ((size * num + den - 1) / den).cast("int"))
    return ((num * (size + other) + num + den - 1) / (num + den)).cast("int")


def witness_keys(line: Column, least: Fraction) -> Column:
    """Keys of which two sets that overlap by ``least``, with two elements in common or more, share at least one.

    ``line`` is the set as a sorted array of (hot, code).  Such sets share
    ceil(least * size) elements of either, so one of the first size - that + 1 in
    any common order; if every one they share there is hot, all they share are hot,
    and two of them lie in a prefix longer by one.
    """
    size = F.size(line)
    first = size - F.ceil(size * least.numerator / F.lit(least.denominator)).cast("int") + 1
    lone = F.transform(F.filter(F.slice(line, 1, first), lambda e: ~e["hot"]), lambda e: e["code"])
    hots = F.filter(F.slice(line, 1, F.least(size, first + 1)), lambda e: e["hot"])
    twins = F.flatten(
        F.transform(hots, lambda x, i: F.transform(F.filter(hots, lambda y, j: j > i), lambda y: F.xxhash64(x["code"], y["code"])))
    )
    return F.when(size > 0, F.concat(lone, twins)).otherwise(F.array().cast("array<bigint>"))


def hot_limit(rows: int) -> int:
    """How many records make a key hot: at most HOT_SHARE keys can reach it, whatever the data, so their list stays under 200 kB."""
    return max(64, rows // HOT_SHARE)


def witness_rows(lines: DataFrame, least: Fraction, smallest: int, any_hot: bool, work: Workspace, name: str) -> DataFrame:
    """(node, key): witnesses of every set, such that similar sets share one; lines are (node, line, size) as of :func:`witness_keys`."""
    overlap = least_overlap(F.col("size"), least, smallest)
    first = F.col("size") - overlap + 1
    rows = lines.select("node", "line", first.alias("first"), overlap.alias("overlap"))
    lone = rows.select("node", F.explode(F.transform(F.filter(F.slice("line", 1, F.col("first")), lambda e: ~e["hot"]), lambda e: e["code"])).alias("key"))
    if not any_hot:
        return lone
    hots = F.filter(F.slice("line", 1, F.col("first") + 1), lambda e: e["hot"])
    longer = F.filter(F.slice("line", 1, F.col("first") + 2), lambda e: e["hot"])
    pairs = F.flatten(
        F.transform(hots, lambda x, i: F.transform(F.filter(F.transform(hots, lambda y, j: F.struct(y["code"].alias("code"), j.alias("at"))), lambda y: y["at"] > i), lambda y: F.struct(F.xxhash64(x["code"], y["code"]).alias("key"), y["at"].alias("at"))))
    )
    twins = rows.where("overlap > 1").select("node", "overlap", longer.alias("longer"), F.explode(pairs).alias("t"))
    # the hot elements after the second of a pair, in the prefix that is longer by one more
    twins = twins.select("node", "overlap", "t.key", F.transform(F.expr("slice(longer, t.at + 2, greatest(size(longer), 1))"), lambda e: e["code"]).alias("rest"))
    twins = work.save(twins, f"{name}-twins")
    often = work.save(twins.groupBy("key").count().where(F.col("count") >= hot_limit(twins.count())).select("key", F.lit(True).alias("often")), f"{name}-often")
    marked = twins.join(F.broadcast(often), "key", "left")
    plain = marked.where("often is null or overlap < 3").select("node", "key")
    triples = marked.where("often and overlap > 2").select("node", "key", F.explode("rest").alias("third")).select("node", F.xxhash64("key", "third").alias("key"))
    # a hot element of sets that share no second one: sets of one element, equal to any similar to them
    single = rows.where("overlap < 2").select("node", F.explode(F.transform(F.slice("line", 1, F.col("first")), lambda e: e["code"])).alias("key"))
    return lone.unionByName(plain).unionByName(triples).unionByName(single)


def far_apart(x: str, y: str) -> Column:
    """Jaccard distance of the codes of two aliased tables."""
    both = F.size(F.array_intersect(f"{x}.codes", f"{y}.codes"))
    return 1 - both / (F.col(f"{x}.size") + F.col(f"{y}.size") - both)


def similar_classes(records: DataFrame, least: Fraction = Fraction(3, 5), smallest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Similar classes of equal sets: (pairs(a, b, shared, size_a, size_b), members(node, id)).

    ``records`` is (id, items) as of :func:`record_sets`, sets of ``smallest`` elements
    or more; a class is named by its smallest id, a < b.  Every pair of distinct sets
    with overlap of ``least`` or more is found.  ``least`` must exceed 1/3.
    """
    if least <= Fraction(1, 3):
        raise ValueError("the overlap threshold must exceed 1/3")
    work = Workspace(records.sparkSession, "setjoin")
    keyed = records.where(F.size("items") >= smallest).select("id", "items", F.transform("items", lambda x: F.xxhash64(x)).alias("codes"))
    keyed = work.save(keyed.select("id", "items", F.array_sort("codes").alias("codes")), "records")
    heads = keyed.groupBy("items").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("codes").alias("codes"))
    nodes = work.save(heads.select("items", "codes", "node", "n", F.size("codes").alias("size")), "nodes")
    members = join_heads(keyed.select("id", "items"), nodes, "items", "node", "n", keyed.count()).select("node", "id")

    limit = hot_limit(nodes.agg(F.sum("size")).first()[0] or 0)
    hot = work.save(nodes.select(F.explode("codes").alias("code")).groupBy("code").count().where(F.col("count") >= limit).select("code", F.lit(True).alias("hot")), "hot")
    any_hot = not hot.isEmpty()
    flagged = nodes.select("node", F.explode("codes").alias("code")).join(F.broadcast(hot), "code", "left").groupBy("node")
    flagged = flagged.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("hot", F.lit(False)).alias("hot"), "code"))).alias("line"))
    lines = work.save(flagged.select("node", "line", F.size("line").alias("size")), "lines")

    # records without a common witness have no partner
    witnesses = work.save(witness_rows(lines, least, smallest, any_hot, work, "near"), "witnesses")
    first = witnesses.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("rank"), "node")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.node").alias("pivot"))
    active = work.save(witnesses.join(first, "key").select("key", "node", "pivot"), "active")
    sets = nodes.select("node", "codes", "size")

    # pivots: the first record of all its witnesses; homes: the nearest pivot within half the reach
    net = active.groupBy("node").agg(F.min(F.col("node") == F.col("pivot")).alias("leads")).where("leads").select(F.col("node").alias("pivot"))
    held = active.where("node <> pivot").join(net, "pivot", "left_semi").select("node", "pivot").distinct()
    pivots = sets.select(F.col("node").alias("pivot"), "codes", "size").alias("p")
    asked = held.join(sets, "node").alias("x").join(pivots, "pivot").select("x.node", "pivot", far_apart("x", "p").alias("far"))
    reach = 1 - float(least)
    near_home = asked.where(F.col("far") <= reach / 2 + ROUNDING).groupBy("node").agg(F.min(F.struct("far", "pivot")).alias("h"))
    homes = work.save(near_home.select("node", F.col("h.pivot").alias("pivot"), F.col("h.far").alias("far")), "homes")
    cells = work.save(homes.groupBy("pivot").agg(F.max("far").alias("radius")), "cells")

    # records with no pivot near are pivots of radius 0: whoever is within reach shares a witness with them
    everyone = active.select("node").distinct()
    lone = everyone.join(homes.select("node"), "node", "left_anti").join(cells.select(F.col("pivot").alias("node")), "node", "left_anti")
    beside = active.select("key", "node").join(sets, "node").alias("y")
    around = active.select("key", "node").join(lone.withColumn("alone", F.lit(True)), "node").join(sets, "node").alias("x")
    both = F.size(F.array_intersect("x.codes", "y.codes"))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & sizes_allow("x", "y", least)
    direct = around.join(beside, meet & overlap_reaches(both, F.col("x.size"), F.col("y.size"), least))
    direct = direct.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    found = direct
    if not cells.isEmpty():
        found = direct.unionByName(within_cells(lines, everyone, homes, cells, sets, least, smallest, any_hot, work))
    close = work.save(found.distinct(), "close")
    # exact check on the elements themselves: codes are 64-bit hashes of them
    whole = nodes.select("node", "items")
    exact = (
        close.join(whole.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
        .join(whole.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
        .select("a", "b", F.size(F.array_intersect("ia", "ib")).alias("shared"), F.size("ia").alias("size_a"), F.size("ib").alias("size_b"))
        .where(overlap_reaches(F.col("shared"), F.col("size_a"), F.col("size_b"), least))
    )
    return exact, members


def sizes_allow(x: str, y: str, least: Fraction) -> Column:
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (a * least.denominator >= b * least.numerator) & (b * least.denominator >= a * least.numerator)


def within_cells(
    lines: DataFrame, everyone: DataFrame, homes: DataFrame, cells: DataFrame, sets: DataFrame, least: Fraction, smallest: int, any_hot: bool, work: Workspace
) -> DataFrame:
    """(a, b): similar records of which one is at home in a cell: each home record joined with all records of the cell."""
    reach = 1 - float(least)
    # whoever is within radius + reach of a pivot overlaps it by 1 - 3/2 reach, so shares a witness of that overlap
    wide = 1 - Fraction(3, 2) * (1 - least)
    keys = work.save(witness_rows(lines.join(everyone, "node", "left_semi"), wide, smallest, any_hot, work, "cell"), "cell-witnesses")
    ask = keys.join(cells.select(F.col("pivot").alias("node")), "node", "left_semi").select("key", F.col("node").alias("pivot"))
    seen = keys.join(ask, "key").select("node", "pivot").distinct()
    pivots = sets.select(F.col("node").alias("pivot"), "codes", "size").join(cells, "pivot").alias("p")
    placed = seen.join(sets, "node").alias("x").join(pivots, "pivot").select("pivot", "x.node", "x.codes", "x.size", far_apart("x", "p").alias("far"), "radius")
    placed = placed.where(F.col("far") <= F.col("radius") + reach + ROUNDING)
    own = homes.select("node", F.col("pivot").alias("home"))
    at_home = (F.col("home") == F.col("pivot")) | (F.col("node") == F.col("pivot"))
    placed = work.save(placed.join(own, "node", "left").select("pivot", "node", "codes", "size", "far", F.coalesce(at_home, F.lit(False)).alias("at_home")), "placed")
    blocks = placed.groupBy("pivot").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("blocks"))
    cut = placed.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = cut.where("at_home").withColumn("other", every).alias("x")
    y = cut.withColumn("other", every).alias("y")
    r, s = F.col("x.far"), F.col("y.far")
    both = F.size(F.array_intersect("x.codes", "y.codes"))
    near = (
        (F.col("x.pivot") == F.col("y.pivot"))
        & (F.col("x.block") == F.col("y.other"))
        & (F.col("x.other") == F.col("y.block"))
        & (F.col("x.node") != F.col("y.node"))
        & (~F.col("y.at_home") | (F.col("x.node") < F.col("y.node")))
        & (F.abs(r - s) <= reach + ROUNDING)
        & sizes_allow("x", "y", least)
        & ((r + s <= reach - ROUNDING) | overlap_reaches(both, F.col("x.size"), F.col("y.size"), least))
    )
    return x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def similar_set_pairs(records: DataFrame, least: Fraction = Fraction(3, 5)) -> DataFrame:
    """(id_a, id_b): every pair of ids whose sets reach ``least``, equal sets included; id_a < id_b."""
    pairs, members = similar_classes(records, least)
    work = Workspace(records.sparkSession, "set-pairs")
    members = work.save(members, "members")
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    sizes = work.save(sizes.withColumn("blocks", F.ceil(F.col("n") / CELL_BLOCK).cast("int")), "sizes")
    same = sizes.where("n > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = members.select(F.col("id").alias("path"), F.col("node").alias("value"))
    # members of near classes side by side, large classes in blocks
    found = between_values(pairs.select("a", "b").unionByName(same), sizes, rows, F.lit(True), F.lit(1.0))
    return found.select(F.col("src").alias("id_a"), F.col("dst").alias("id_b"))


def similar_set_summary(records: DataFrame, least: Fraction = Fraction(3, 5)) -> DataFrame:
    """(id, class_id, links): every record with its class of equal sets and the number of other records similar to it."""
    pairs, members = similar_classes(records, least)
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("far")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("far")))
    reach = ends.join(sizes.select(F.col("node").alias("far"), "n"), "far").groupBy("node").agg(F.sum("n").alias("outside"))
    own = sizes.join(reach, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
    return members.join(own, "node").select("id", F.col("node").alias("class_id"), "links")

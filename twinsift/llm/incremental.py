"""Deduplicating new batches against all history, without working through history again.

The history of a medium is a folder that outlives the session: :meth:`History.create`
makes it, :meth:`History.open` goes on with it, and :meth:`History.ingest` decides one
batch.  Its blocking-key table holds a row per key of every accepted item and is
bucketed by key, so a batch is probed by shuffling the batch alone: the buckets of
history are read in place.  Duplicates leave no keys.  Keys are exact: an item near an
accepted one shares a key with it, whatever the size of the history.  Images have one
key per part of the hash, with part widths by the size of the history
(:mod:`twinsift.operators.hamming`; the batch alone enumerates bit flips); videos have
the witnesses of :mod:`twinsift.llm.setjoin`.  When the history outgrows the plan, the
keys are written anew, with new widths, hot lists and buckets.

Candidates that pass the near test are links, scored by Fellegi-Sunter weights of
agreement that expectation maximisation learns from a bounded sample of pairs; the
score chooses the accepted record a duplicate is filed under.

Within a batch records count in the order of their ids: a record near an earlier
accepted one of its own batch is a duplicate too (:mod:`twinsift.operators.grouping`).
Accepted items that duplicates tie together are clusters, kept as a union-find log
(item, parent): a batch looks up the roots of the items it ties and appends a row per
root that gets a parent; no row is written again.  A duplicate ties all items near it
that were accepted before it came, not only the one it is filed under.

A step is a folder of every table; the state file that names it is written last, so a
step that did not end is done again and leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.components import component_roots
from twinsift.llm.setjoin import overlap_reaches, witness_keys
from twinsift.llm.shared import Workspace, usable_hash, usable_set
from twinsift.operators import hamming as H
from twinsift.operators.grouping import ONE_TASK_EDGES, assign_leaders, first_come
from twinsift.operators.skew import join_heads

SAMPLE_ROWS = 4_000
BITS = 256
#: The keys are planned anew when the history holds this many times what they were planned for.
OUTGROWN = 8
#: Rows of one file of a batch.
FILE_ROWS = 200_000
#: Pending batches share a step up to this many rows, or this many times the rows of the history they are held against.
STEP_ROWS, STEP_SHARE = 30_000, 2
#: A look-up, beside a stored key: it is shuffled with its item in every step, so it costs disk above all.
LOOK_UP_COST = 6.0
ID_BITS = 40


@dataclass
class Medium:
    """How items of one kind are keyed and compared: everything :class:`History` needs to know."""

    name: str
    payload: dict[str, str]
    #: rows once per key, as they are stored and as they are looked up
    stored: Callable[[DataFrame], DataFrame]
    asked: Callable[[DataFrame], DataFrame]
    near: Callable[[str, str], Column]
    #: smaller is closer; part of the agreement levels
    gap: Callable[[str, str], Column]
    gap_edges: list[float]


def word_columns(text: Column) -> list[Column]:
    """A 64-digit hex text as four signed 64-bit words."""
    return [F.conv(F.substring(text, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"w{i}") for i in range(4)]


def image_medium(plan: dict, hot: DataFrame | None = None) -> Medium:
    """256-bit hashes within ``plan["reach"]`` bits, keyed by the parts of the plan; ``hot`` are keys to refine."""
    reach, parts = plan["reach"], tuple(H.Part(*p) for p in plan["parts"])

    def keyed(probing: bool) -> Callable[[DataFrame], DataFrame]:
        def rows(df: DataFrame) -> DataFrame:
            out = H.keyed(df, parts, BITS, probing)
            return out if hot is None else H.refine_hot(out, hot, parts, BITS, reach)

        return rows

    def apart(x: str, y: str) -> Column:
        return H.distance(x, y, BITS)

    words = {n: "bigint" for n in H.word_names(BITS)}
    return Medium("image", words, keyed(False), keyed(True), lambda x, y: apart(x, y) <= reach, lambda x, y: apart(x, y).cast("double"), [0.0, 8.0, 16.0, float(reach), 64.0])


def video_medium(plan: dict) -> Medium:
    """Sets of element codes with overlap ``plan["least"]``.

    ``plan["hot"]`` are codes known to be frequent; they come last in the order of
    witnesses.  The list only matters for speed: any list is exact.
    """
    least, hot = Fraction(*plan["least"]), plan["hot"]
    common = F.array(*[F.lit(int(h)) for h in sorted(hot)]) if hot else F.array().cast("array<bigint>")

    def keyed(df: DataFrame) -> DataFrame:
        line = F.array_sort(F.transform("codes", lambda c: F.struct(F.array_contains(common, c).alias("hot"), c.alias("code"))))
        # equal sets, also of one element, share the key of the whole set; any other similar pair has two elements in common
        keys = F.concat(F.array(F.xxhash64("codes")), F.array_except(F.array_distinct(witness_keys(line, least)), F.array(F.xxhash64("codes"))))
        return df.select("*", F.posexplode(keys).alias("part", "key"))

    def both(x: str, y: str) -> Column:
        return F.size(F.array_intersect(f"{x}.codes", f"{y}.codes"))

    def near(x: str, y: str) -> Column:
        a, b = F.size(f"{x}.codes"), F.size(f"{y}.codes")
        return (a * least.denominator >= b * least.numerator) & (b * least.denominator >= a * least.numerator) & overlap_reaches(both(x, y), a, b, least)

    def gap(x: str, y: str) -> Column:
        return 1 - both(x, y) / F.size(F.array_union(f"{x}.codes", f"{y}.codes"))

    return Medium("video", {"codes": "array<bigint>"}, keyed, keyed, near, gap, [0.0, 0.15, 0.3, 1 - float(least), 0.7])


def learn_weights(levels: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...], rounds: int = 60) -> list[list[float]]:
    """Agreement weights log2(m / u) per field and level, without labels: expectation maximisation of a mixture of matches and others.

    ``levels`` has a row per pattern and a column per field, level 0 the closest;
    ``counts`` are the pairs of each pattern.  Fields are independent given the class.
    One pair is added to every level, so no weight is infinite.
    """
    # matches begin as the closer ones
    m = [np.linspace(2.0, 1.0, n) / np.linspace(2.0, 1.0, n).sum() for n in sizes]
    u = [p[::-1].copy() for p in m]
    share = 0.5
    for _ in range(rounds):
        yes = share * np.prod([p[levels[:, i]] for i, p in enumerate(m)], axis=0)
        no = (1 - share) * np.prod([p[levels[:, i]] for i, p in enumerate(u)], axis=0)
        weight = yes / (yes + no)
        share = float(np.clip((weight * counts).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
        for probabilities, part in ((m, weight * counts), (u, (1 - weight) * counts)):
            for i, n in enumerate(sizes):
                held = np.bincount(levels[:, i], part, minlength=n) + 1.0
                probabilities[i] = held / held.sum()
    return [np.log2(a / b).round(4).tolist() for a, b in zip(m, u)]


def agreement(x: Column, y: Column) -> Column:
    """0 equal, 1 unknown, 2 different."""
    return F.when(x.isNull() | y.isNull(), 1).when(x == y, 0).otherwise(2)


class History:
    """Accepted items of one medium.  Items are rows (id, payload, format, bytes), the payload of images w0..w3, that of videos codes."""

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.state = spark, state
        self.work = Workspace(spark, "history", path)
        hot = None
        if state["kind"] == "image" and state["hot_keys"]:
            hot = self.work.read(f"hot-{state['generation']}", spark.createDataFrame([], "key long"))
        self.medium = image_medium(state["plan"], hot) if state["kind"] == "image" else video_medium(state["plan"])
        self.columns = ["id", *self.medium.payload, "format", "bytes"]
        self.register()

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, kind: str, sample: DataFrame | None = None, expected: int = 100_000, batch: int = 100_000,
        reach: int = 25, least: Fraction = Fraction(3, 5), buckets: int | None = None, clusters: bool = False,
    ) -> History:
        """A new history below ``path``, planned for ``expected`` accepted items and batches of ``batch``; ``sample`` are items that show what is frequent."""
        if kind not in ("image", "video"):
            raise ValueError("the kind of a history is image or video")
        state = {"kind": kind, "reach": reach, "least": [least.numerator, least.denominator], "generation": 0, "step": -1, "accepted": 0, "weights": None, "clusters": clusters, "ties": []}
        state |= cls.planned(spark, Workspace(spark, "history", path), state, sample, expected, batch, buckets)
        history = cls(spark, path, state)
        history.commit()
        return history

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history below ``path`` as of its last whole step."""
        return cls(spark, path, json.loads(Workspace(spark, "history", path).read_text("state.json")))

    @staticmethod
    def planned(spark: SparkSession, work: Workspace, state: dict, sample: DataFrame | None, expected: int, batch: int, buckets: int | None) -> dict:
        """What a generation of keys depends on."""
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found: dict = {"planned": max(expected, 1), "batch": max(batch, 1), "hot_keys": False, "first": state["step"] + 1}
        if state["kind"] == "image":
            parts = H.plan_parts(BITS, state["reach"], max(expected, 1), max(batch, 1), LOOK_UP_COST)
            found["plan"] = {"reach": state["reach"], "parts": [[p.begin, p.end, p.reach] for p in parts]}
            rows = max(expected, 1) * len(parts)
            if sample is not None:
                # copies are one item to a batch, so they do not make a key hot
                sample = sample.select("id", *H.word_names(BITS)).dropDuplicates(H.word_names(BITS))
                count = sample.count()
                hot = H.hot_keys(sample.withColumnRenamed("id", "node"), count, parts, BITS) if count > H.HOT_ROWS else None
                if hot is not None:
                    found["hot_keys"] = not work.save(hot, f"hot-{state['generation']}").isEmpty()
        else:
            found["plan"] = {"least": state["least"], "hot": common_codes(sample) if sample is not None else []}
            rows = max(expected, 1) * 12
        # a bucket of some million keys at most
        found["buckets"] = max(buckets or 0, least, -(-rows // 4_000_000))
        return found

    def register(self) -> None:
        """Name the key table in the session's catalog; its rows are the folder's alone, whatever the catalog."""
        s = self.state
        location = self.work.path(f"keys-{s['generation']}")
        self.table = f"twinsift_keys_{s['kind']}_{hashlib.sha256(location.encode()).hexdigest()[:24]}"
        kinds = {"id": "bigint", **self.medium.payload, "format": "string", "bytes": "bigint", "part": "int", "key": "bigint", "step": "int"}
        columns = ", ".join(f"{n} {k}" for n, k in kinds.items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet PARTITIONED BY (step) CLUSTERED BY (key) INTO {s['buckets']} BUCKETS LOCATION '{location}'")
        held = " ".join(f"PARTITION (step={n})" for n in range(s["first"], s["step"] + 1))
        if held:
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {held}")

    def commit(self) -> None:
        self.work.write_text("state.json", json.dumps(self.state))

    def past(self) -> DataFrame:
        return self.spark.table(self.table).where(F.col("step") <= self.state["step"])

    def append(self, items: DataFrame, step: int) -> None:
        """Write the blocking keys of accepted items; a step that is written again replaces what it wrote before."""
        rows = self.medium.stored(items.select(*self.columns)).select(*self.columns, F.col("part").cast("int").alias("part"), "key")
        view = f"{self.table}_{step}"
        rows.repartition(self.state["buckets"], "key").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (step={step}) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def accept(self, items: DataFrame, rows: int | None = None) -> None:
        """A step of items that are accepted unseen; ``rows``: how many, where that is known."""
        step = self.state["step"] + 1
        self.arrived(items, step)
        self.append(items, step)
        self.state |= {"step": step, "accepted": self.state["accepted"] + (items.count() if rows is None else rows)}
        self.finish()

    def arrived(self, items: DataFrame, step: int) -> None:
        self.work.save(items.select("id"), f"arrived/step={step}")

    def learn(self, items: DataFrame, rows: int = SAMPLE_ROWS) -> None:
        """Learn the weights from the pairs that share a key among at most ``rows`` items, chosen by hash of the id."""
        rank = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
        share = min(1.0, 1.2 * rows / max(1, items.count()))
        part = self.work.save(items.where(rank < int(share * 1_000_000)).orderBy(rank, "id").limit(rows).select(*self.columns), "learning")
        x, y = self.medium.stored(part).alias("x"), self.medium.stored(part).alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
        levels = [F.coalesce(c, F.lit(0)).alias(f"l{i}") for i, c in enumerate(self.levels("x", "y"))]
        counts = pairs.select("x.id", F.col("y.id").alias("other"), *levels).distinct().groupBy("l0", "l1", "l2").count().toPandas()  # one row per pattern
        sizes = (len(self.medium.gap_edges) + 1, 3, 3)
        self.state["weights"] = learn_weights(counts[["l0", "l1", "l2"]].to_numpy(np.int64).reshape(-1, 3), counts["count"].to_numpy(float), sizes)

    def levels(self, x: str, y: str) -> list[Column]:
        gap = self.medium.gap(x, y)
        level = F.lit(len(self.medium.gap_edges))
        for i, edge in reversed(list(enumerate(self.medium.gap_edges))):
            level = F.when(gap <= edge, i).otherwise(level)
        return [level, agreement(F.col(f"{x}.format"), F.col(f"{y}.format")), agreement(F.col(f"{x}.bytes"), F.col(f"{y}.bytes"))]

    def score(self, x: str, y: str) -> Column:
        total: Column = F.lit(0.0)
        for level, weights in zip(self.levels(x, y), self.state["weights"]):
            total = total + F.element_at(F.array(*[F.lit(float(w)) for w in weights]), level + 1)
        return total

    def ingest(self, items: DataFrame) -> DataFrame:
        """(id, keeper, score) of one batch of items, keeper null where accepted.

        Of several rows of an id one counts; ids that came in an earlier batch are left
        out.  Items without payload are not for a history.  The accepted ones are in the
        history once this returns.
        """
        step = self.state["step"] + 1
        before = self.spark.read.schema("id long, step int").parquet(self.work.path("arrived")).where(F.col("step") < step) if step else None
        fresh = items.where("id is not null").select(*self.columns).dropDuplicates(["id"])
        fresh = self.work.save(fresh if before is None else fresh.join(before.select("id"), "id", "left_anti"), f"batch/step={step}").withColumn("step", F.lit(step))
        classes = self.work.save(copy_classes(fresh, list(self.medium.payload)), f"classes/step={step}")
        self.arrived(fresh, step)
        decided = self.decide(classes.drop("step"))
        self.finish()
        return self.expand(fresh, decided.withColumn("step", F.lit(step))).select("id", "keeper", "score")

    def decide(self, classes: DataFrame) -> DataFrame:
        """The classes of one batch with keeper (null where accepted) and score; the step is taken but not committed.

        ``classes`` is (id, payload, format, bytes, copies, last) as of :func:`copy_classes`:
        copies within the batch are one item named by its smallest id.
        """
        step = self.state["step"] + 1
        if self.state["weights"] is None:
            self.learn(classes)
        buckets = self.state["buckets"]
        items = classes.select(*self.columns)
        # the batch is the smaller side: hash tables are made of it, and the buckets of history stream past unsorted
        x = self.medium.asked(items).drop("part").repartition(buckets, "key").hint("shuffle_hash").alias("x")
        y = self.medium.stored(items).drop("part").repartition(buckets, "key").alias("y")
        link = [F.col("x.id").alias("id"), F.col("y.id").alias("other"), self.score("x", "y").alias("score")]
        near = y.join(x, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & self.medium.near("x", "y")).select(*link, F.lit(False).alias("old"))
        if self.state["accepted"]:
            past = self.past().alias("y")
            near = near.unionByName(past.join(x, (F.col("x.key") == F.col("y.key")) & self.medium.near("x", "y")).select(*link, F.lit(True).alias("old")))
        near = self.work.save(near.distinct(), f"near-{step}")
        keepers = keepers_of(near, near.count())
        decided = self.work.save(classes.join(keepers, "id", "left"), f"decided/step={step}")
        kept = decided.where("keeper is null")
        self.append(kept, step)
        if self.state["clusters"]:
            self.tie(self.links(near, decided), decided, step)
        self.work.drop(f"near-{step}")
        self.state |= {"step": step, "accepted": self.state["accepted"] + kept.count()}
        return decided

    def finish(self) -> None:
        """Commit the step, plan the keys anew where the history has outgrown them, and let go of what the step leaves in the driver and in shuffle files."""
        self.commit()
        if self.state["accepted"] > OUTGROWN * self.state["planned"]:
            self.rebuild()
        self.work.free()

    def rebuild(self) -> None:
        """Write the keys anew, planned for twice the items accepted so far."""
        old, table = self.work.path(f"keys-{self.state['generation']}"), self.table
        items = self.work.save(self.past().select(*self.columns).distinct(), f"items-{self.state['generation']}")
        last, self.state["step"] = self.state["step"], self.state["step"] - 1
        self.state["generation"] += 1
        self.state |= self.planned(self.spark, self.work, self.state, items, 2 * self.state["accepted"], max(self.state["batch"], 2 * self.state["accepted"]), None)
        self.__init__(self.spark, self.work.root, self.state)
        self.append(items, last)
        self.state["step"] = last
        self.commit()
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.work.drop(old.rsplit("/", 1)[1], f"items-{self.state['generation'] - 1}")

    def links(self, near: DataFrame, decided: DataFrame) -> DataFrame:
        """(id, other): each duplicate class of a step with every item near it accepted before the last of its copies came."""
        kept = decided.where("keeper is null").select("id")
        mates = near.where("not old").select("id", "other")
        before = mates.join(kept.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")
        # accepted after the first copy of the class, which is a duplicate, and before the last
        between = mates.join(kept, "id", "left_semi").select(F.col("other").alias("id"), F.col("id").alias("other"))
        between = between.join(decided.where("keeper is not null").select("id", "last"), "id").where("other < last").select("id", "other")
        return near.where("old").select("id", "other").unionByName(before).unionByName(between)

    def tie(self, links: DataFrame, decided: DataFrame, step: int) -> None:
        """Append to the union-find log what the links of a step merge: a duplicate ties its keeper to the other items near it."""
        ties = links.join(decided.where("keeper is not null").select("id", "keeper"), "id").where("keeper <> other")
        ties = self.work.save(ties.select(F.col("keeper").alias("a"), F.col("other").alias("b")).distinct(), f"ties-{step}")
        if not ties.isEmpty():
            merged = merged_roots(ties, self.parents(), self.work, f"step-{step}")
            self.work.save(merged, f"parents/step={step}")
            self.state["ties"] = [*self.state["ties"], step]
        self.work.drop(f"ties-{step}")

    def parents(self) -> DataFrame:
        """(item, parent): the union-find log of all whole steps."""
        log = self.spark.createDataFrame([], "item long, parent long")
        steps = self.state["ties"]
        return self.spark.read.schema(log.schema).parquet(*[self.work.path(f"parents/step={n}") for n in steps]) if steps else log

    def members(self, decided: DataFrame) -> DataFrame:
        """(record_id, cluster_id) of every duplicate and of every accepted item near one; a cluster is named by the smallest id of its accepted items
        (ids of :func:`run_batches` sort by arrival, so there it is the one accepted first).

        ``decided`` is (id, keeper, ...) of all batches.
        """
        log = self.parents()
        filed = self.work.save(decided.where("keeper is not null").select(F.col("id").alias("record_id"), F.col("keeper").alias("item")), "filed")
        ends = log.select("item").unionByName(log.select(F.col("parent").alias("item")))
        heads = self.work.save(filed.select("item").unionByName(ends).groupBy("item").agg(F.count("*").alias("n")), "heads")
        roots = find_roots(heads.select(F.col("item").alias("node")), log, self.work, "members")
        named = self.work.save(heads.join(roots.withColumnRenamed("node", "item"), "item").select("item", "root", "n"), "named")
        rows = filed.unionByName(heads.select(F.col("item").alias("record_id"), "item"))
        return join_heads(rows, named, "item", "root", "n", rows.count()).select("record_id", F.col("root").alias("cluster_id"))

    def expand(self, items: DataFrame, decided: DataFrame, count: int | None = None) -> DataFrame:
        """(id, step, keeper, score) of every item: copies of a class follow its first one.

        ``decided`` is what :meth:`decide` returned, with step; ``count`` is the number of
        items, where that is known.  Classes of very many copies are joined apart, so no
        task gets all copies of one hash.
        """
        lone = decided.where("copies = 1").select("id", "step", "keeper", "score")
        heads = decided.where("copies > 1").select(F.struct("step", *self.medium.payload).alias("class"), F.struct(F.col("id").alias("head"), "keeper", "score").alias("first"), "copies")
        rows = items.select("id", "step", F.struct("step", *self.medium.payload).alias("class"))
        copies = join_heads(rows, heads, "class", "first", "copies", items.count() if count is None else count)
        head = F.col("id") == F.col("first.head")
        copies = copies.select(
            "id", "step", F.when(head, F.col("first.keeper")).otherwise(F.coalesce("first.keeper", "first.head")).alias("keeper"),
            F.when(head, F.col("first.score")).otherwise(F.coalesce("first.score", F.lit(0.0))).alias("score"),
        )
        return lone.unionByName(copies)

    def forget(self, *names: str) -> None:
        """Drop the key table and what only a run over many batches needs, or the folders named; results already read are gone with them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.work.drop(*(names or (f"keys-{self.state['generation']}", "learning")))


def resolved(links: pd.DataFrame) -> pd.DataFrame:
    """(id, keeper, score) of the duplicates among all links (id, other, score, old) of a batch."""
    links = links.sort_values(["id", "score", "other"], ascending=[True, False, True])
    hits = links[links["old"]].drop_duplicates("id")
    mates = links[~links["old"] & ~links["id"].isin(hits["id"]) & ~links["other"].isin(hits["id"])]
    joined = first_come(pd.DataFrame({"a": mates["other"], "b": mates["id"]}))
    inner = joined.merge(mates, left_on=["node", "leader"], right_on=["id", "other"])
    return pd.concat([hits, inner])[["id", "other", "score"]].rename(columns={"other": "keeper"})


def keepers_of(near: DataFrame, count: int) -> DataFrame:
    """(id, keeper, score) of every duplicate: the accepted item of greatest score, else the first of its batch by first come.

    ``near`` is (id, other, score, old) and has ``count`` rows; up to ONE_TASK_EDGES of
    them are resolved by one bounded task, more by joins.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(parts)
        if whole:
            yield resolved(pd.concat(whole, ignore_index=True))

    if count <= ONE_TASK_EDGES:
        return near.coalesce(1).mapInPandas(run, "id long, keeper long, score double")
    hits = near.where("old").groupBy("id").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("best"))
    hits = hits.select("id", (-F.col("best.o")).alias("keeper"), F.col("best.score").alias("score"))
    mates = near.where("not old")
    fresh = mates.join(hits.select("id"), "id", "left_anti").join(hits.select(F.col("id").alias("other")), "other", "left_anti")
    joined = assign_leaders(fresh.select(F.col("other").alias("a"), F.col("id").alias("b")), ONE_TASK_EDGES)
    inner = joined.join(mates, (F.col("node") == F.col("id")) & (F.col("leader") == F.col("other"))).select(F.col("node").alias("id"), F.col("leader").alias("keeper"), "score")
    return hits.unionByName(inner)


def find_roots(nodes: DataFrame, parents: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) by the log (item, parent): follows parents to the end; a node without one is its own root."""
    at = work.save(nodes.select("node", F.col("node").alias("root")).distinct(), f"roots-{name}-0")
    turn = 0
    while True:
        turn += 1
        up = at.join(parents.select(F.col("item").alias("root"), "parent"), "root", "left")
        moved = work.save(up.select("node", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved")), f"roots-{name}-{turn}")
        at = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return at


def merged_roots(links: DataFrame, parents: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(item, parent) to append for new links (a, b): the roots of their ends, those of one component below the smallest of them."""
    roots = find_roots(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))), parents, work, name)
    named = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("src")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("dst")), "b")
    found = component_roots(named.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    first = found.groupBy("root").agg(F.min("node").alias("parent"))
    return found.join(first, "root").where("node <> parent").select(F.col("node").alias("item"), "parent")


def first_arrivals(df: DataFrame, id_col: str, payload: list[Column], fmt: Column, size: Column) -> DataFrame:
    """(id, batch_no, payload, format, bytes): one row per id, at its smallest batch; later rows of the id change nothing else."""
    names = [f"p{i}" for i in range(len(payload))]
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), "batch_no", *[c.alias(n) for c, n in zip(payload, names)], fmt.alias("format"), size.alias("bytes")
    )
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(n)))).alias(n) if "array" in dict(rows.dtypes)[n] else F.max(n).alias(n) for n in names]
    return rows.groupBy("id").agg(F.min("batch_no").alias("batch_no"), *merged, F.min("format").alias("format"), F.max("bytes").alias("bytes")).where("batch_no is not null")


def copy_classes(items: DataFrame, payload: list[str]) -> DataFrame:
    """Items with equal payload as one row per step: the smallest id, its fields, the number of copies and the largest id."""
    grouped = items.groupBy("step", *payload).agg(F.min(F.struct("id", "format", "bytes")).alias("m"), F.count("*").alias("copies"), F.max("id").alias("last"))
    return grouped.select("m.*", *payload, "copies", "last", "step")


def plan_steps(batches: list[tuple[int, int]], held: int) -> list[int]:
    """How many of the pending (batch, rows) the next step takes: batches in order while they hold no more than STEP_ROWS rows or STEP_SHARE times the history, one at least.

    A step reads the history once, so a long queue of small batches costs a number of
    reads that grows with the logarithm of its length.
    """
    taken, rows = [batches[0][0]], batches[0][1]
    for batch, count in batches[1:]:
        rows += count
        if rows > max(STEP_ROWS, STEP_SHARE * held):
            break
        taken.append(batch)
    return taken


def batch_sizes(items: DataFrame, *by: str) -> list[Row]:
    """(batch_no, n, low, high) of every batch in order, by "batch_no", or (n, low, high) of all items: how many there are, and between which ids."""
    return sorted(items.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect())


def run_batches(history: History, arrivals: DataFrame, accepted: DataFrame | None, sizes: list[Row] | None = None, held: Row | None = None) -> tuple[DataFrame, int]:
    """(id, step, keeper, score) of every arrival, and the number of bits of an id; above them ids hold the batch, so that they sort by order of arrival.

    ``sizes`` and ``held`` are the :func:`batch_sizes` of arrivals and accepted items, where they have been taken.
    """
    payload = list(history.medium.payload)
    work = history.work
    if accepted is not None:
        accepted = work.save(accepted.select(*history.columns), "accepted")
        held = batch_sizes(accepted)[0] if held is None else held
        history.accept(accepted, held["n"])
    sizes = batch_sizes(arrivals, "batch_no") if sizes is None else sizes
    batches, count = [(r["batch_no"], r["n"]) for r in sizes], sum(r["n"] for r in sizes)
    ids = [i for r in (*sizes, *([held] if accepted is not None else [])) for i in (r["low"], r["high"]) if i is not None]
    fits = min((*ids, *[b for b, _ in batches]), default=0) >= 0 and max(ids, default=0) < 1 << ID_BITS and max((b for b, _ in batches), default=0) < 1 << (62 - ID_BITS)
    place = F.shiftleft(F.col("batch_no").cast("long"), ID_BITS).bitwiseOR(F.col("id")) if fits else F.col("id")
    placed = arrivals.select(place.alias("id"), *payload, "format", "bytes", F.col("batch_no").alias("step"))
    files = -(-max((n for _, n in batches), default=1) // FILE_ROWS)
    placed = work.save(placed.repartition(max(1, len(batches)) * files, "step", F.pmod(F.xxhash64("id"), F.lit(files))), "placed", by=["step"])
    decided: DataFrame | None = None
    while batches:
        taken = plan_steps(batches, history.state["accepted"]) if fits else [batches[0][0]]
        batches = batches[len(taken) :]
        items = placed.where(F.col("step").between(taken[0], taken[-1])).withColumn("step", F.lit(taken[0]))
        classes = work.save(copy_classes(items, payload).drop("step"), f"classes/step={history.state['step'] + 1}")
        found = history.decide(classes).withColumn("step", F.lit(taken[0]))
        history.finish()
        step = F.when(F.col("step").between(taken[0], taken[-1]), taken[0]).otherwise(F.col("step"))
        decided, placed = found if decided is None else decided.unionByName(found), placed.withColumn("step", step)
    if decided is None:
        return placed.select("id", "step", F.lit(None).cast("long").alias("keeper"), F.lit(None).cast("double").alias("score")), 63
    return history.expand(placed, decided, count), ID_BITS if fits else 63


def deduplicate_batches(history: History, arrivals: DataFrame, accepted: DataFrame | None, sizes: list[Row] | None = None, held: Row | None = None) -> DataFrame:
    """(id, keeper, score) of every arrival, batch after batch; keeper null where accepted.

    ``arrivals`` is (id, batch_no, payload, format, bytes), one row per id; ``accepted``
    the same without batch_no, taken without test.  The order is (batch_no, id).
    Consecutive batches share a step as of :func:`plan_steps`, which changes no result.
    """
    rows, bits = run_batches(history, arrivals, accepted, sizes, held)
    return rows.select(plain("id", bits), plain("keeper", bits), "score")


def plain(column: str, bits: int) -> Column:
    """An id without the batch above it."""
    return F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias(column) if bits < 63 else F.col(column)


def common_codes(items: DataFrame, least_share: float = 0.002, most: int = 500) -> list[int]:
    """The at most ``most`` codes held by a share of ``least_share`` or more of the distinct sets."""
    sets = items.select("codes").distinct()
    count = sets.count()
    rows = sets.select(F.explode("codes").alias("c")).groupBy("c").count().where(F.col("count") >= max(50, least_share * count))
    return [r[0] for r in rows.orderBy(F.desc("count"), "c").limit(most).collect()]


def image_items(df: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, batch_no, w0..w3, format, bytes) of image rows with a usable pHash, one per id."""
    rows = first_arrivals(df, id_col, [usable_hash("phash")], F.col("format"), F.col("file_size"))
    return rows.where("p0 is not null").select("id", "batch_no", *word_columns(F.col("p0")), "format", "bytes")


def video_codes(column: str) -> Column:
    return F.array_sort(F.transform(usable_set(column), lambda x: F.xxhash64(x)))


def video_items(df: DataFrame, id_col: str = "video_id") -> DataFrame:
    """(id, batch_no, codes, format, bytes) of video rows with usable frames, one per id."""
    rows = first_arrivals(df, id_col, [video_codes("frame_hashes")], F.lit(None).cast("string"), F.col("file_size"))
    return rows.where("size(p0) > 0").select("id", "batch_no", F.col("p0").alias("codes"), "format", "bytes")


def known_items(known: DataFrame, media: str) -> DataFrame:
    """(id, payload, format, bytes) of the known records of a medium."""
    rows = known.where(F.col("media") == media).withColumns({"batch_no": F.lit(0), "format": F.lit(None).cast("string"), "file_size": F.lit(None).cast("long")})
    return (image_items if media == "image" else video_items)(rows, "known_id").drop("batch_no")


def history_of(arrivals: DataFrame, known: DataFrame, kind: str, clusters: bool, **options) -> DataFrame:
    """What all batches of ``arrivals`` come to, as (id, keeper, score), or as (record_id, cluster_id)."""
    spark = arrivals.sparkSession
    work = Workspace(spark, f"history-{kind}")
    arrivals, known = work.save(arrivals, "items"), work.save(known, "known")
    sizes, held = batch_sizes(arrivals, "batch_no"), batch_sizes(known)[0]
    start = arrivals.where(F.col("batch_no") == sizes[0]["batch_no"]).drop("batch_no").unionByName(known) if sizes else known
    # planned for what is there at the start; keys are planned anew as the history grows
    rows = max(1, held["n"] + (sizes[0]["n"] if sizes else 0))
    history = History.create(spark, work.path("history"), kind, start, rows, rows, clusters=clusters, **options)
    if clusters:
        decided, bits = run_batches(history, arrivals, known, sizes, held)
        result = history.members(decided).select(plain("record_id", bits), plain("cluster_id", bits))
    else:
        result = deduplicate_batches(history, arrivals, known, sizes, held)
    result = work.save(result, "result")
    history.forget()
    work.drop("history", "items", "known")
    return result


def side_by_side(images: DataFrame, videos: DataFrame, known: DataFrame, clusters: bool = False) -> list[tuple[DataFrame, str]]:
    """The result of both media, worked on at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        left = pool.submit(history_of, image_items(images), known_items(known, "image"), "image", clusters)
        right = pool.submit(history_of, video_items(videos), known_items(known, "video"), "video", clusters)
        return [(left.result(), "image"), (right.result(), "video")]


def duplicates_of_history(images: DataFrame, videos: DataFrame, known: DataFrame) -> DataFrame:
    """(media, record_id, keeper, score) of every arrival that is near something accepted.

    A record arrives once, at its smallest batch_no (rows without one never
    arrive); order of arrival is (batch_no, id).  Records without a usable hash are
    neither accepted nor duplicates.  Equal or repeated rows count once; the two
    media are worked on side by side.
    """
    parts = side_by_side(images, videos, known)
    rows = [df.where("keeper is not null").select(F.lit(m).alias("media"), F.col("id").alias("record_id"), "keeper", "score") for df, m in parts]
    return rows[0].unionByName(rows[1])


def clusters_of_history(images: DataFrame, videos: DataFrame, known: DataFrame) -> DataFrame:
    """(media, record_id, cluster_id) of every duplicate as of :func:`duplicates_of_history` and of every accepted item near one.

    The log of clusters is extended batch after batch, by all links of a duplicate to items accepted before it; a cluster is
    named by the item accepted first.
    """
    rows = [df.select(F.lit(m).alias("media"), "record_id", "cluster_id") for df, m in side_by_side(images, videos, known, clusters=True)]
    return rows[0].unionByName(rows[1])

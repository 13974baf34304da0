"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows.  Rows of one normalised value vote for it with
the trust of their source times a decay by age; the winner of a field is the value
that comes first by the field's policy, and winners are pivoted back to one row per
group.  All steps are aggregations with partial sums, so a group or a path with a
large share of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """What decides between values of a field, most important first: "votes", "value", "recency" or "count"; then the smaller path."""

    order: tuple[str, ...]


#: The survivors asked for: the largest resolution, the latest size and duration.
SURVIVORS = {"resolution": Policy(("value", "recency")), "file_size": Policy(("recency",)), "duration": Policy(("recency",))}
#: Voting over the same fields.
VOTES = {name: Policy(("votes", "recency", "value")) for name in SURVIVORS}


def unpivot_media(images: DataFrame, videos: DataFrame) -> DataFrame:
    """(path, source, field, value, seen): a row per usable field of every row; values are doubles, whole numbers exact to 2^53.

    Usable is a resolution of two positive sides, a size above 0, and a finite duration above 0.
    """

    def long_rows(df: DataFrame, source: str, duration: Column) -> DataFrame:
        sides = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("long") * F.col("height").cast("long"))
        size = F.when(F.col("file_size") > 0, F.col("file_size"))
        fields = F.array(
            F.struct(F.lit("resolution").alias("field"), sides.cast("double").alias("value")),
            F.struct(F.lit("file_size").alias("field"), size.cast("double").alias("value")),
            F.struct(F.lit("duration").alias("field"), duration.alias("value")),
        )
        rows = df.where("path is not null").select("path", F.lit(source).alias("source"), F.col("scanned_at").alias("seen"), F.explode(fields).alias("f"))
        return rows.select("path", "source", "f.field", "f.value", "seen").where("value is not null")

    finite = F.when((F.col("duration") > 0) & ~F.isnan("duration") & (F.col("duration") < float("inf")), F.col("duration"))
    return long_rows(images, "images", F.lit(None).cast("double")).unionByName(long_rows(videos, "videos", finite.cast("double")))


def surviving_values(
    members: DataFrame, fields: DataFrame, policies: dict[str, Policy], trust: dict[str, float] | None = None, half_life_days: float = 180.0, now: str = "2024-01-01"
) -> DataFrame:
    """(group_id, field, value, votes, path): the surviving value of each field of each group, and the path that supplies it.

    ``members`` is (group_id, path), ``fields`` as of :func:`unpivot_media`.
    Repeated members count once, null groups or paths not at all; a member without
    rows adds nothing, and a field without candidates has no row.  A null ``seen``
    is older than any date.  A value is supplied by the row that holds it latest;
    remaining ties go to the smaller path.
    """
    trust = trust or {}
    weight: Column = F.lit(1.0)
    for source, t in sorted(trust.items()):
        weight = F.when(F.col("source") == source, F.lit(float(t))).otherwise(weight)
    oldest = F.lit(-(2**62)).cast("long")
    micros = F.coalesce(F.unix_micros("seen"), oldest)
    age = F.greatest(F.lit(0.0), F.datediff(F.lit(now).cast("date"), F.col("seen").cast("date")).cast("double"))
    vote = weight * F.coalesce(F.pow(F.lit(2.0), -age / F.lit(half_life_days)), F.lit(0.0))
    # repeated rows of a path fold before the join, so a path of many rows is joined once per value and time
    folded = fields.withColumn("at", micros).withColumn("vote", vote).groupBy("path", "field", "value", "at").agg(F.sum("vote").alias("votes"), F.count("*").alias("n"))
    groups = members.select("group_id", "path").where("group_id is not null and path is not null").distinct()
    rows = groups.join(folded, "path")
    dated = rows.groupBy("group_id", "field", "value", "at").agg(F.min("path").alias("path"), F.sum("votes").alias("votes"), F.sum("n").alias("n"))
    valued = dated.groupBy("group_id", "field", "value").agg(F.max_by("path", "at").alias("path"), F.max("at").alias("at"), F.sum("votes").alias("votes"), F.sum("n").alias("n"))
    parts = {"votes": -F.round("votes", 9), "value": -F.col("value"), "recency": -F.col("at").cast("double"), "count": -F.col("n").cast("double")}
    exact_age = -F.col("at")
    result: DataFrame | None = None
    key: Column | None = None
    longest = max(len(p.order) for p in policies.values())
    for place in range(longest):
        column: Column | None = None
        for name, policy in policies.items():
            item = policy.order[place] if place < len(policy.order) else None
            use = F.lit(0.0) if item is None or item == "recency" else parts[item]
            column = F.when(F.col("field") == name, use) if column is None else column.when(F.col("field") == name, use)
        age_column: Column | None = None
        for name, policy in policies.items():
            use = exact_age if place < len(policy.order) and policy.order[place] == "recency" else F.lit(0).cast("long")
            age_column = F.when(F.col("field") == name, use) if age_column is None else age_column.when(F.col("field") == name, use)
        fields_of = [column.alias(f"k{place}"), age_column.alias(f"a{place}")]
        key = F.struct(*fields_of) if key is None else F.struct(key.alias("head"), *fields_of)
    won = valued.where(F.col("field").isin(*policies)).groupBy("group_id", "field").agg(F.min_by(F.struct("value", "votes", "path"), F.struct(key.alias("key"), "path")).alias("w"))
    result = won.select("group_id", "field", "w.value", "w.votes", "w.path")
    return result


def survivors_by_group(survivors: DataFrame, fields: list[str]) -> DataFrame:
    """One row per group with a column per field: the pivot back."""
    chosen = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return survivors.groupBy("group_id").agg(*chosen)

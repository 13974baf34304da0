"""Per-key results where a few keys hold most records: value-frequency compression.

Records are grouped by key and value before they are grouped by key.  The second
step sees each value once, with its weight, and every result here is derived from
weighted values with partial aggregation, so a key with most of the records is
reduced where its records lie.  Percentiles refine a histogram of each key digit by
digit instead of sorting the key's values in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.plans.workspace import Workspace


def compress(df: DataFrame, keys: list[str], value: Column, name: str = "value") -> DataFrame:
    """(keys, value, weight): each distinct value of each key with its number of rows."""
    return df.select(*keys, value.alias(name)).groupBy(*keys, name).agg(F.count("*").alias("weight"))


def top_record(df: DataFrame, keys: list[str], id_col: str, size: Column, least: int = 2) -> DataFrame:
    """(keys, top_id, records): of each key held by ``least`` or more records, the id of greatest size.

    Several rows of an id are one record, of the largest size over its rows (null
    or negative as 0).  Ties go to the smaller id.  Rows with a null key or id are
    left out.
    """
    usable = df.where(F.col(id_col).isNotNull())
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    records = usable.groupBy(*keys, F.col(id_col).alias("id")).agg(F.max(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).alias("size"))
    values = records.groupBy(*keys, "size").agg(F.count("*").alias("weight"), F.min("id").alias("id"))
    tops = values.groupBy(*keys).agg(F.max_by("id", "size").alias("top_id"), F.sum("weight").alias("records"))
    return tops.where(F.col("records") >= least)


def join_heads(rows: DataFrame, heads: DataFrame, key: str, value: str, count: str, total: int) -> DataFrame:
    """Rows (key, ...) with the ``value`` of their key's head (key, value, count); rows without a head are left out.

    Keys with more than a thousandth of the ``total`` rows are joined by broadcast, so
    none of them fills a task; there are fewer than a thousand of these.
    """
    large = heads.where(F.col(count) > max(10_000, total // 1_000))
    marked = rows.join(F.broadcast(large.select(key, F.col(value).alias("_large"), F.lit(True).alias("_hot"))), key, "left")
    rest = marked.where("_hot is null").drop("_large", "_hot").join(heads.where(F.col(count) <= max(10_000, total // 1_000)).select(key, value), key)
    return rest.unionByName(marked.where("_hot").withColumnRenamed("_large", value).drop("_hot"))


def weighted_summary(weighted: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, records, n_values, mode, mode_weight) of weighted values; a null value is a value of no distinct count, as in SQL.

    The mode is the value of greatest weight, the smaller one on ties; null only if all are null.
    """
    known = F.col(value).isNotNull()
    return weighted.groupBy(*keys).agg(
        F.sum("weight").alias("records"),
        F.count(F.when(known, 1)).alias("n_values"),
        F.min_by(F.when(known, F.col(value)), F.when(known, F.struct(-F.col("weight"), F.col(value)))).alias("mode"),
        F.max(F.when(known, F.col("weight"))).alias("mode_weight"),
    )


def weighted_percentiles(weighted: DataFrame, keys: list[str], shares: list[float], value: str = "value", digit_bits: int = 12) -> DataFrame:
    """(keys, share, value): the smallest value at or below which a ``share`` of the key's records lie (percentile_disc).

    Values are integers; nulls do not count and a key of nulls only has no row.
    Each pass looks at ``digit_bits`` more bits of the values: it sums the weights
    per (key, leading bits), a table of at most 2 ** digit_bits rows per key, and
    keeps for each key and share the bin that holds the wanted rank.  A key of any
    size is thus never sorted as a whole.  Each pass reads the values left in the bins
    that are still open, so all passes together shuffle little more than the first.
    """
    known = weighted.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("v"), "weight")
    wanted = known.groupBy(*keys).agg(F.sum("weight").alias("total"))
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("total") * F.col("share"), 6)))
    open_ = wanted.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).select(*keys, "share", target.alias("rank"), F.lit(None).cast("long").alias("bin"))
    work = Workspace(weighted.sparkSession, "percentiles")
    rows, shift = known, 64
    while shift > 0:
        last, shift = shift, max(0, shift - digit_bits)
        binned = rows.groupBy(*keys, *([] if last == 64 else ["up"]), F.shiftright("v", shift).alias("bin")).agg(F.sum("weight").alias("w"))
        sums = open_.drop("bin").join(binned, keys) if last == 64 else open_.withColumnRenamed("bin", "up").join(binned, [*keys, "up"]).drop("up")
        below = F.sum("w").over(Window.partitionBy(*keys, "share").orderBy("bin"))
        chosen = sums.withColumn("below", below).where((F.col("below") >= F.col("rank")) & (F.col("below") - F.col("w") < F.col("rank")))
        open_ = work.save(chosen.select(*keys, "share", (F.col("rank") - (F.col("below") - F.col("w"))).alias("rank"), "bin"), f"open-{shift}")
        if shift:
            # what lies outside the open bins is never read again
            kept = rows.withColumn("up", F.shiftright("v", shift)).join(open_.select(*keys, F.col("bin").alias("up")).distinct(), [*keys, "up"], "left_semi")
            rows = work.save(kept, f"rows-{shift}")
    return open_.select(*keys, "share", F.col("bin").alias(value))

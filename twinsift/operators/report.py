"""Reports over duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions import formatting as T


def latest_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row per path: the last by ``order``.  Rows with a null path are left out."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return df.where("path is not null").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def group_report(groups: DataFrame, infos: DataFrame, media: str = "image") -> DataFrame:
    """A display row per group member that has a record; members without one are left out."""
    joined = groups.join(infos, "path")
    columns = ["group_id", "rank", "path", T.resolution_text("width", "height").alias("resolution"), T.size_text("file_size").alias("size"), T.percent_text("similarity").alias("similarity_text")]
    if media == "image":
        columns.append(F.when(F.col("format").isNull() | (F.col("format") == ""), "Unknown").otherwise(F.col("format")).alias("format"))
    else:
        columns.append(T.duration_text("duration").alias("duration"))
    return joined.select(*columns)


def group_savings(groups: DataFrame, infos: DataFrame) -> DataFrame:
    """(group_id, members, known, savings): bytes saved by keeping the largest member; 0 with one known size."""
    joined = groups.join(infos.select("path", "file_size"), "path", "left")
    known = F.count("file_size")
    saved = F.when(known > 1, F.sum("file_size") - F.max("file_size")).otherwise(F.lit(0))
    return joined.groupBy("group_id").agg(F.count("*").alias("members"), known.alias("known"), saved.cast("long").alias("savings"))


def totals(savings: DataFrame) -> DataFrame:
    """(total_groups, total_duplicates, potential_savings_bytes) in one row, zeros without groups."""
    return savings.agg(
        F.count("*").alias("total_groups"),
        F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("total_duplicates"),
        F.coalesce(F.sum("savings"), F.lit(0)).alias("potential_savings_bytes"),
    )

"""Fingerprints of files as they arrive.

Groups depend on the order of all rows, so a stream keeps the fingerprint table and
its exact matches up to date; groups are made from the table in batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from twinsift.constants import EXCLUDED_FOLDERS, IMAGE_EXTENSIONS
from twinsift.functions.paths import is_excluded
from twinsift.schema import IMAGE_ROW
from twinsift.sources.catalog import extension_glob
from twinsift.sources.media import read_images


def watch_rows(spark: SparkSession, source: str, schema: str = IMAGE_ROW, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of fingerprint rows from Parquet files added to a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source)


def watch_images(spark: SparkSession, folder: str, target: str, checkpoint: str, hash_size: int = 16, extensions: Iterable[str] = IMAGE_EXTENSIONS, excluded: Iterable[str] = EXCLUDED_FOLDERS) -> StreamingQuery:
    """Append the image rows of new files under ``folder`` to the Parquet table ``target``, each file once: the files that a listing finds."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", extension_glob(extensions))
    files = reader.load(folder).select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), "length").where(~is_excluded("path", excluded))

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote before
        read_images(batch.sparkSession, batch, hash_size).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_matches(rows: DataFrame) -> DataFrame:
    """(phash, path, first_path): rows of a stream whose pHash came before under another path, however long ago.

    The state of a hash is the path that came first, by (``scanned_at``, ``path``) within
    a micro-batch: one row for any number of copies, and each copy gives one row, not
    one per earlier copy.  Rows without a hash or path match nothing.
    """

    def first_paths(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(batches), ignore_index=True)[["path", "scanned_at"]].sort_values(["scanned_at", "path"], na_position="first")
        first = state.get[0] if state.exists else arrived["path"].iloc[0]
        state.update((first,))
        copies = arrived.loc[arrived["path"] != first, "path"]
        yield pd.DataFrame({"phash": pd.Series([key[0]] * len(copies), dtype=object), "path": pd.Series(list(copies), dtype=object), "first_path": pd.Series([first] * len(copies), dtype=object)})

    usable = rows.where("phash is not null and phash <> '' and path is not null").select("phash", "path", "scanned_at")
    return usable.groupBy("phash").applyInPandasWithState(first_paths, "phash string, path string, first_path string", "first string", "append", GroupStateTimeout.NoTimeout)


def arrivals_per_window(rows: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(begin, files, bytes): rows and bytes per tumbling window of ``scanned_at``; late rows beyond the watermark do not count."""
    grouped = rows.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", window).alias("w"))
    return grouped.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).select(F.col("w.start").alias("begin"), "files", "bytes")

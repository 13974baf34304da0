"""SQL names for the functions of the engine, and the pixel hashes as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twinsift.constants import SKIPPED_SHARE
from twinsift.functions import pixels
from twinsift.functions.formatting import UNITS


def hash_udf(kind: str, hash_size: int, side: int) -> Column:
    """A UDF: an array column of side * side grey levels -> hex hash of a kind; null for null or arrays of another length."""

    @F.pandas_udf(StringType())
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(
                [
                    None if v is None or len(v) != side * side else pixels.image_hashes(np.asarray(v, float).clip(0, 255).astype(np.uint8).reshape(side, side), hash_size, (kind,))[kind]
                    for v in values
                ],
                dtype=object,
            )

    return hashed


def words_sql(text: str) -> str:
    """The 64-bit words of a hash text, as :func:`twinsift.functions.bits.hex_words` has them."""
    digits = f"(cast(ceil(length({text}) / 16) as int) * 16)"
    return f"transform(sequence(1, {digits}, 16), i -> cast(conv(substring(lpad({text}, {digits}, '0'), i, 16), 16, -10) as bigint))"


def size_sql(size: str) -> str:
    arms = " ".join(f"when {size} / {float(1024**p)}D < 1024 then format_string('%.2f {u}', bround({size} / {float(1024**p)}D, 2))" for p, u in enumerate(UNITS[:-1]))
    return f"case when {size} is null then null {arms} else format_string('%.2f {UNITS[-1]}', bround({size} / {float(1024 ** (len(UNITS) - 1))}D, 2)) end"


DISTANCE = f"aggregate(zip_with({words_sql('a')}, {words_sql('b')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
#: A distance is null unless both are hex texts of one length.
COMPARABLE = "length(a) = length(b) and regexp_like(a, '^[0-9a-fA-F]+$') and regexp_like(b, '^[0-9a-fA-F]+$')"
WHOLE = "cast(floor(s) as bigint)"
BEGIN, END = f"cast(n * {SKIPPED_SHARE}D as bigint)", f"cast(n * {1 - SKIPPED_SHARE}D as bigint)"
SQL_FUNCTIONS = {
    "hamming": ("a STRING, b STRING", "INT", f"case when {COMPARABLE} then {DISTANCE} end"),
    "similarity": ("a STRING, b STRING", "DOUBLE", f"case when {COMPARABLE} then 1 - {DISTANCE} / (4 * length(a)) end"),
    "squared_similarity": ("a STRING, b STRING", "DOUBLE", f"case when {COMPARABLE} then 1 - {DISTANCE} / (16 * length(a) * length(a)) end"),
    "size_text": ("n DOUBLE", "STRING", size_sql("n")),
    "duration_text": (
        "s DOUBLE", "STRING",
        f"case when s is null or isnan(s) or abs(s) = double('infinity') then null when {WHOLE} div 3600 > 0 then format_string('%dh %dm %ds', {WHOLE} div 3600, pmod({WHOLE}, 3600) div 60, pmod({WHOLE}, 60)) "
        f"when pmod({WHOLE}, 3600) div 60 > 0 then format_string('%dm %ds', pmod({WHOLE}, 3600) div 60, pmod({WHOLE}, 60)) else format_string('%ds', pmod({WHOLE}, 60)) end",
    ),
    "frame_indices": (
        "n BIGINT, k INT", "ARRAY<BIGINT>",
        f"case when n > 0 then filter(transform(sequence(1, k), i -> if({END} <= {BEGIN}, 0, {BEGIN}) + i * greatest(1, (if({END} <= {BEGIN}, n - 1, {END}) - if({END} <= {BEGIN}, 0, {BEGIN})) div (k + 1))), p -> p < n) else array() end",
    ),
    "hash_digest": ("h ARRAY<STRING>", "STRING", "md5(array_join(filter(h, x -> x is not null and x <> ''), ''))"),
    "resolution": ("w INT, h INT", "STRING", "concat(w, 'x', h)"),
}


def register(spark: SparkSession, prefix: str = "twinsift_") -> list[str]:
    """Create temporary SQL functions (JVM expressions, not Python): the names created."""
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in SQL_FUNCTIONS]

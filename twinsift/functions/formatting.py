"""Display texts.

Sizes are rounded half-even before printf, which rounds half-up: a size over a power
of 1024 has few binary digits, so this agrees with rounding the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.bits import col

UNITS = ("B", "KB", "MB", "GB", "TB")


def size_text(size: Column | str) -> Column:
    """Bytes with two decimals in the largest unit of which there is one or more, TB at most; null for null."""
    n = col(size).cast("double")
    text = F.format_string("%.2f TB", F.bround(n / float(1024**4), 2))
    for power in reversed(range(4)):
        scaled = n / float(1024**power)
        text = F.when(scaled < 1024, F.format_string(f"%.2f {UNITS[power]}", F.bround(scaled, 2))).otherwise(text)
    return F.when(n.isNotNull(), text)


def duration_text(seconds: Column | str) -> Column:
    """Whole seconds as 1h 1m 1s, leading zero units left out; null for null, NaN or infinite."""
    s = col(seconds).cast("double")
    whole = F.floor(s)
    h, m, r = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    text = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), text)


def resolution_text(width: Column | str, height: Column | str) -> Column:
    return F.concat(col(width).cast("string"), F.lit("x"), col(height).cast("string"))


def percent_text(share: Column | str) -> Column:
    """A share from 0 to 2 with one decimal of its percentage, rounded from the exact binary value, ties to even.

    The percentage is taken as a whole number of 2**-52 (2**-58 below 1), which is exact, and divided in integers.
    """

    def tenths(percent: Column, bits: int) -> Column:
        scaled = (percent * float(1 << bits)).cast("bigint") * 10
        whole = F.shiftright(scaled, bits)
        rest, half = scaled - F.shiftleft(whole, bits), 1 << (bits - 1)
        return whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)

    s = col(share)
    percent = s * 100
    n = F.when(percent < 1, tenths(percent, 58)).otherwise(tenths(percent, 52))
    text = F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"), F.lit("%"))
    return F.when((s >= 0) & (s <= 2), text).when(s.isNotNull(), F.format_string("%.1f%%", F.bround(percent, 1)))

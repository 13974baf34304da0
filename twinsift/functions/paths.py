"""Predicates on file paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.constants import EXCLUDED_FOLDERS
from twinsift.functions.bits import col


def has_extension(path: Column | str, extensions: Iterable[str]) -> Column:
    """The path ends in an extension, all lower or all upper case."""
    p = col(path)
    tests = [p.endswith(e) for x in sorted(extensions) for e in dict.fromkeys((x, x.upper()))]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_excluded(path: Column | str, folders: Iterable[str] = EXCLUDED_FOLDERS, whole_names: bool = False) -> Column:
    """A part of the path contains an excluded token, in any case.

    The file name is a part too.  With ``whole_names`` a folder must equal a token
    instead (the stricter reading: ``my_windows_pics`` stays).
    """
    parts = F.split(F.lower(col(path)), "/")
    tokens = sorted(folders)
    if whole_names:
        return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(t) for t in tokens])) if tokens else F.lit(False)
    if any("/" in t for t in tokens):
        raise ValueError("an excluded token cannot span folders")
    lowered = F.lower(col(path))
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in tokens], F.lit(False))

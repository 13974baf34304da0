"""What the operators of this subpackage share: intermediate tables and hash text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.plans.workspace import Workspace, shared_folder

__all__ = ["Workspace", "shared_folder", "usable_hash", "usable_set"]


def usable_hash(column: Column | str, digits: int = 64) -> Column:
    """The hash without blanks at the ends and in lower case, or null unless that is exactly ``digits`` hex digits."""
    text = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when((F.length(text) == digits) & text.rlike(f"^[0-9a-f]{{{digits}}}$"), text)


def usable_set(column: Column | str, digits: int = 64) -> Column:
    """The distinct usable hashes of an array of hashes; empty for null."""
    raw = F.col(column) if isinstance(column, str) else column
    cleaned = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda h: F.lower(F.trim(h)))
    good = F.filter(cleaned, lambda h: (F.length(h) == digits) & h.rlike(f"^[0-9a-f]{{{digits}}}$"))
    return F.array_distinct(good)

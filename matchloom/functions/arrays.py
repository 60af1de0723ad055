"""Arrays as sets; null arrays count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(values: Column) -> Column:
    return F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(as_set(a), as_set(b)))


def union_size(a: Column, b: Column) -> Column:
    return F.size(F.array_union(as_set(a), as_set(b)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Size of the intersection over that of the union; `empty` where both are empty."""
    return F.when(union_size(a, b) == 0, F.lit(empty)).otherwise(overlap(a, b) / union_size(a, b))


def shares(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(as_set(a), as_set(b)), F.lit(False))


def clean_tokens(values: Column) -> Column:
    """Stripped lower-case non-empty tokens, each once."""
    stripped = F.transform(as_set(values), lambda v: F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(stripped, lambda v: v != ""))

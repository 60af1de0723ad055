"""Profiles of sources and truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PAIR


def profile(sources: dict[str, DataFrame]) -> DataFrame:
    """Per source: rows, distinct and repeated ids, and missing values with their percentage by column."""

    def one(name: str, df: DataFrame) -> DataFrame:
        blank = lambda c: F.sum((F.trim(F.coalesce(c, F.lit(""))) == "").cast("long"))
        share = lambda c: F.round(100 * blank(c) / F.count(F.lit(1)), 4)
        counts = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_ids"), (F.count("entity_id") - F.count_distinct("entity_id")).alias("repeated_ids")]
        missing = [x for c, s in (("business_name", "name"), ("business_address", "address"), ("country", "country")) for x in (blank(c).alias(f"missing_{s}"), share(c).alias(f"missing_{s}_percent"))]
        return df.agg(*counts, *missing).select(F.lit(name).alias("source"), "*")

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in sources.items()])


def countries(df: DataFrame) -> DataFrame:
    name = F.when(F.trim(F.coalesce("country", F.lit(""))) == "", "<MISSING>").otherwise(F.col("country"))
    return df.groupBy(name.alias("country")).agg(F.count(F.lit(1)).alias("n"))


def truth_buckets(truth: DataFrame) -> DataFrame:
    """One row: entities with 0, 1, 2 and more matches, and matched to S2, S3 and both."""
    n = F.size("matched")
    s2, s3 = (F.size(F.filter("matched", _starts(p))) > 0 for p in ("S2-", "S3-"))
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return truth.agg(total(n == 0, "none"), total(n == 1, "one"), total(n == 2, "two"), total(n >= 3, "more"), total(s2, "to_s2"), total(s3, "to_s3"), total(s2 & s3, "to_both"))


def _starts(prefix: str):
    return lambda v: v.startswith(prefix)


def id_differences(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities without truth, and truth without an entity."""
    ids, known = s1.select(F.col("entity_id").alias(PAIR[0])), truth.select(PAIR[0])
    a = ids.join(known, PAIR[0], "left_anti").agg(F.count(F.lit(1)).alias("without_truth"))
    return a.crossJoin(known.join(ids, PAIR[0], "left_anti").agg(F.count(F.lit(1)).alias("without_entity")))  # one row each


def oddities(df: DataFrame, column: str, pattern: str, n: int = 20) -> DataFrame:
    """The first n values by id that match a pattern, to look at."""
    return df.where(F.col(column).rlike(pattern)).select("entity_id", column).orderBy("entity_id").limit(n)

"""Heuristic scores of candidate pairs, top k per entity, and pruning reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..schema import PAIR
from .evaluation import summary
from .features import enrich

#: Weights of the two feature scores.
LIGHT = {"name_norm_exact": 100, "address_norm_exact": 100, "country_exact": 20, "numeric_jaccard": 10, "name_token_jaccard": 5, "address_token_jaccard": 5}
HEAVY = {"name_norm_exact": 1000, "address_norm_exact": 1000, "country_exact": 100, "numeric_jaccard": 50, "name_token_jaccard": 30, "address_token_jaccard": 30}


def weighted_score(weights: dict[str, float]) -> Column:
    """Sum of weighted feature columns."""
    return sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))


def _points(condition: Column, points: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(float(points))).otherwise(F.lit(0.0))


def jaccard_score() -> Column:
    """Over records `a` and `b`: equal compact name and address, country without case, and Jaccard of numbers and tokens."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda c: (a(c) != "") & (a(c) == b(c))
    country = [F.lower(F.trim(x("country"))) for x in (a, b)]
    score = _points(same("name_compact"), 1000) + _points(same("address_compact"), 1000) + _points((country[0] != "") & (country[0] == country[1]), 100)
    for column, weight in (("address_numbers", 50), ("name_tokens", 30), ("address_tokens", 30)):
        score = score + arrays.jaccard(a(column), b(column)) * F.lit(float(weight))
    return score


def boolean_score() -> Column:
    """Over records `a` and `b`: equalities, prefixes, shared elements, and bonuses for close lengths (empty ones too)."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    full = lambda c: (a(c) != "") & (b(c) != "")
    score = _points(full("name_compact") & (a("name_compact") == b("name_compact")), 1000) + _points(full("address_compact") & (a("address_compact") == b("address_compact")), 1000)
    score = score + _points(full("country") & (a("country") == b("country")), 100)
    for column, n in (("name_compact", 5), ("address_compact", 8)):
        score = score + _points(full(column) & (F.left(a(column), F.lit(n)) == F.left(b(column), F.lit(n))), 40)
    for column, points in (("name_tokens", 30), ("address_tokens", 30), ("address_numbers", 50)):
        score = score + _points(arrays.shares(a(column), b(column)), points)
    for column, near, far in (("name_compact", 2, 5), ("address_compact", 5, 12)):
        gap = F.abs(F.length(a(column)) - F.length(b(column)))
        score = score + F.when(gap <= near, 10.0).when(gap <= far, 5.0).otherwise(0.0)
    return score


def score_pairs(pairs: DataFrame, s1: DataFrame, targets: DataFrame, score: Column) -> DataFrame:
    return enrich(pairs, s1, targets).select(*PAIR, score.alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best pairs of each entity, ties by id, with their rank; Spark cuts groups before the shuffle too."""
    order = Window.partitionBy(PAIR[0]).orderBy(F.col(score).desc(), PAIR[1])
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sweep(scored: DataFrame, truth_pairs: DataFrame, entities: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """For each k: candidates, recalls and counts per entity.

    Pairs are ranked once, cut at the largest k and aggregated once; an entity's figures for every k follow from its row.
    """
    ranked = top_k(scored, max(ks)).select(*PAIR, "rank").join(truth_pairs.withColumn("hit", F.lit(1)), list(PAIR), "left")
    hits = [F.count(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"hits_{k}") for k in ks]
    per_entity = ranked.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"), *hits)
    true = truth_pairs.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true"))
    whole = entities.select(F.col("entity_id").alias(PAIR[0])).distinct().join(per_entity, PAIR[0], "left").join(true, PAIR[0], "left").na.fill(0)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.least("n", F.lit(k).cast("long")).alias("n"), F.col(f"hits_{k}").alias("n_found")) for k in ks])
    return summary(whole.select("n_true", F.explode(each).alias("x")).select("n_true", "x.*"))

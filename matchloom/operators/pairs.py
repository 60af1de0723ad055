"""Labelled pairs: positives, negatives, hard negatives, samples and splits.

Sampling orders rows by md5 of ids and seed: equal on every run and engine, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAIR, LinkageError, SchemaError
from ..sources.scratch import written
from .evaluation import Truth, marked, truth_pairs
from .features import feature_frame

#: Columns whose sum is a hard negative's score.
HARD_FEATURES = ("name_ratio", "name_jaro_winkler", "name_token_set_ratio", "address_ratio", "address_token_set_ratio", "numeric_jaccard", "country_exact")


def spread(*columns: str, seed: int = 42) -> Column:
    """A pseudo-random text to order by."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))).cast("binary"))


def positives(truth: DataFrame) -> DataFrame:
    """Pairs of the truth with label 1, blank ids left out."""
    return truth_pairs(truth).where((F.trim(PAIR[0]) != "") & (F.trim(PAIR[1]) != "")).withColumn("label", F.lit(1))


def label(pairs: DataFrame, truth: Truth) -> DataFrame:
    """Pairs with label 1 where the truth has them, else 0."""
    return marked(pairs, truth, "label").withColumn("label", F.coalesce("label", F.lit(0)))


def _wanted(labelled: DataFrame, ratio: int) -> DataFrame:
    """Negatives wanted of each entity: its positives in the pool times ratio, or ratio if it has none."""
    n = labelled.groupBy(PAIR[0]).agg(F.sum("label").alias("positives"))
    return n.select(PAIR[0], F.when(F.col("positives") > 0, F.col("positives") * ratio).otherwise(F.lit(ratio)).alias("wanted"))


def _first_negatives(labelled: DataFrame, ratio: int, order: list) -> DataFrame:
    if ratio < 1:
        raise LinkageError("ratio must be positive")
    rows = labelled.where("label = 0").withColumn("place", F.row_number().over(Window.partitionBy(PAIR[0]).orderBy(*order)))
    return rows.join(_wanted(labelled, ratio), PAIR[0]).where("place <= wanted").drop("place", "wanted")


def negatives(candidates: DataFrame, truth: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    """Sampled candidates that aren't matches, with label 0."""
    return _first_negatives(label(candidates.select(*PAIR).distinct(), truth), ratio, [spread(*PAIR, seed=seed), F.col(PAIR[1])])


def hard_negatives(scored: DataFrame, truth: DataFrame, ratio: int = 1, features: tuple[str, ...] = HARD_FEATURES) -> DataFrame:
    """The candidates most like matches that aren't: label 0 and hard_negative_score; absent feature columns count 0."""
    total = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features if f in scored.columns), F.lit(0.0))
    labelled = label(scored.select(*PAIR, total.alias("hard_negative_score")), truth)
    return _first_negatives(labelled, ratio, [F.round("hard_negative_score", 9).desc(), F.col(PAIR[1])])


def pair_dataset(candidates: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    """Features and labels of positives and sampled negatives inside the candidate pool whose records exist."""
    chosen = positives(truth).unionByName(negatives(candidates, truth, ratio, seed)).dropDuplicates(list(PAIR))
    pool = candidates.join(chosen, list(PAIR))
    return feature_frame(pool, s1, targets).join(chosen, list(PAIR))


def sample_entities(s1: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n records in md5 order."""
    return s1.orderBy(spread("entity_id", seed=seed), "entity_id").limit(n)


def with_distractors(records: DataFrame, required: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The required records (ids in `required.entity_id`; all must exist) and n others."""
    ids = required.select("entity_id").distinct()
    if lost := [r[0] for r in ids.join(records, "entity_id", "left_anti").limit(10).collect()]:
        raise LinkageError(f"required records are missing: {lost}")
    return records.join(ids, "entity_id", "left_semi").unionByName(sample_entities(records.join(ids, "entity_id", "left_anti"), n, seed))


def _groups(df: DataFrame, group: str) -> DataFrame:
    if group not in df.columns:
        raise SchemaError(f"no column {group}")
    if df.isEmpty():
        raise LinkageError("nothing to split")
    if not df.where(F.col(group).isNull()).isEmpty():
        raise LinkageError(f"null in {group}")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def _numbered(groups: DataFrame, group: str, order: list) -> DataFrame:
    """Groups with place 0, 1, ... in an order, numbered by range partitions: no single task sorts all groups.

    A range partition numbers its own rows; the written table fixes these numbers, and the rows of the partitions before
    (one row a partition) are added to them.
    """
    at = written(groups.orderBy(*order).select(group, F.monotonically_increasing_id().alias("at")), "numbered")
    own = at.select(group, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = own.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return own.join(bases, "part").select(group, (F.col("base") + F.col("own")).alias("place"))


def batches(entities: DataFrame, size: int, key: str = "entity_id") -> DataFrame:
    """key, batch: runs of `size` entities in order of the key. Spark needs none to run; writers and readers may."""
    if size < 1:
        raise LinkageError("size must be positive")
    return _numbered(entities.select(key).distinct(), key, [F.col(key)]).select(key, F.floor(F.col("place") / size).alias("batch"))


def next_batch(numbered: DataFrame) -> DataFrame:
    """One row: the number that follows the highest batch, 0 without any."""
    return numbered.agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).cast("long").alias("next_batch"))


def split_groups(df: DataFrame, shares: tuple[float, ...], group: str = PAIR[0], seed: int = 42) -> list[DataFrame]:
    """Frames whose groups don't overlap: ceil(share) of all groups for every share after the first, the rest for it."""
    if any(not 0 < s < 1 for s in shares[1:]) or sum(shares[1:]) >= 1:
        raise LinkageError("shares must lie between 0 and 1")
    groups = _groups(df, group)
    total = groups.count()
    numbered = _numbered(groups, group, [spread(group, seed=seed), F.col(group)])
    parts, start = [], 0
    for share in shares[1:]:
        end = start + -int(-(share * total) // 1)
        parts.append(df.join(numbered.where(F.col("place").between(start, end - 1)).select(group), group, "left_semi"))
        start = end
    return [df.join(numbered.where(F.col("place") >= start).select(group), group, "left_semi"), *parts]


def train_validation(df: DataFrame, validation: float = 0.2, group: str = PAIR[0], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, valid = split_groups(df, (1 - validation, validation), group, seed)
    return train, valid


def three_way(entities: DataFrame, seed: int = 42) -> list[DataFrame]:
    """70 % to train on, 15 % to tune and 15 % to evaluate."""
    return split_groups(entities, (0.7, 0.15, 0.15), "entity_id", seed)


def fold_of(df: DataFrame, n: int, group: str = PAIR[0]) -> DataFrame:
    """group, fold: groups in order of size dealt out to and fro, so the folds' row counts stay close."""
    groups = _groups(df, group)
    if n < 2 or n > groups.count():
        raise LinkageError("more folds than groups, or fewer than two")
    place = F.pmod("place", F.lit(2 * n))
    numbered = _numbered(groups, group, [F.col("n").desc(), F.col(group)])
    return numbered.select(group, F.least(place, 2 * n - 1 - place).cast("int").alias("fold"))


def group_kfold(df: DataFrame, n: int, group: str = PAIR[0]) -> list[tuple[DataFrame, DataFrame]]:
    rows = df.join(fold_of(df, n, group), group)
    return [(rows.where(F.col("fold") != i).drop("fold"), rows.where(F.col("fold") == i).drop("fold")) for i in range(n)]

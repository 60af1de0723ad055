"""Writers of tables, match lists and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PAIR, SOURCE, LinkageError
from .scratch import written


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "error"


def _suffix(path: str, suffix: str) -> None:
    if not path.rstrip("/").endswith(suffix):
        raise LinkageError(f"{path} doesn't end in {suffix}")


def write_parquet(df: DataFrame, path: str, *, overwrite: bool = True) -> None:
    _suffix(path, ".parquet")
    df.write.mode(_mode(overwrite)).parquet(path)


def write_csv(df: DataFrame, path: str, *, overwrite: bool = True) -> None:
    _suffix(path, ".csv")
    df.write.mode(_mode(overwrite)).csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, *, overwrite: bool = True) -> None:
    df.write.mode(_mode(overwrite)).json(path)


def list_per_entity(entities: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One row per S1 entity, ordered ids of its pairs joined by commas, empty for those without."""
    ids = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias(column))
    rows = entities.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return rows.join(ids, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def write_lists(lists: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Tab-separated lists in order of the entity: range-partitioned, so that no task sorts all rows, unless one file is asked for."""
    # A coalesced sort keeps the order only where all its parts are equally near, so one file is one task's sort.
    ordered = lists.repartition(1).sortWithinPartitions(lists.columns[0]) if single_file else lists.orderBy(lists.columns[0])
    ordered.write.mode("overwrite").options(sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", nullValue="").csv(path)


def write_source(df: DataFrame, path: str) -> None:
    """The raw columns of a source, tab-separated, as `readers.read_source` reads them."""
    df.select(*SOURCE.fieldNames()).write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def both_lists(entities: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_ids, matched_entity_ids of each entity, from one aggregation of both."""
    rows = candidates.select(*PAIR, F.lit(0).alias("of")).unionByName(matches.select(*PAIR, F.lit(1).alias("of")))
    ids = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("of") == i, F.col(PAIR[1])))), ",").alias(c) for i, c in enumerate(("candidate_entity_ids", "matched_entity_ids"))]
    return entities.select(F.col("entity_id").alias(PAIR[0])).distinct().join(rows.groupBy(PAIR[0]).agg(*ids), PAIR[0], "left").na.fill("")


def write_both_outputs(entities: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str) -> DataFrame:
    """Write both lists from one computation: they are aggregated once into a table, which is returned, and written from it."""
    lists = written(both_lists(entities, candidates, matches), "lists")
    write_lists(lists.select(PAIR[0], "candidate_entity_ids"), f"{folder}/candidates.tsv")
    write_lists(lists.select(PAIR[0], "matched_entity_ids"), f"{folder}/matches.tsv")
    return lists

"""Readers of tab-separated sources, truth and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import SOURCE, TRUTH, SchemaError

#: Fixed names of the files of a split.
FILES = {"S1": "source1.tsv", "S2": "source2.tsv", "S3": "source3.tsv"}


def _tsv(spark: SparkSession, path: str, schema: StructType, quoted_breaks: bool = False) -> DataFrame:
    """Files are split between tasks at line breaks, unless `quoted_breaks` says that values hold some: then a file is one task's."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": quoted_breaks, "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns
    if missing := [c for c in schema.fieldNames() if c not in header]:
        raise SchemaError(f"{path}: missing columns {missing}")
    all_text = StructType().fromJson({"type": "struct", "fields": [{"name": c, "type": "string", "nullable": True, "metadata": {}} for c in header]})
    return spark.read.schema(all_text).options(**options).csv(path).na.fill("")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in SOURCE.fieldNames() if c not in df.columns]


def source_problems(df: DataFrame) -> DataFrame:
    """problem, entity_id, n: ids that are empty (as one row) or stand in several rows, from one aggregation."""
    blank = F.trim(F.coalesce("entity_id", F.lit(""))) == ""
    ids = df.groupBy(F.when(~blank, F.col("entity_id")).otherwise("").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.where("entity_id = '' OR n > 1").select(F.when(F.col("entity_id") == "", "empty entity_id").otherwise("repeated entity_id").alias("problem"), "entity_id", "n")


def check_source(df: DataFrame, source: str = "source") -> DataFrame:
    """The frame itself, or SchemaError for missing columns, empty ids or repeated ids."""
    if missing := missing_columns(df):
        raise SchemaError(f"{source}: missing columns {missing}")
    if found := source_problems(df).orderBy("problem", "entity_id").limit(10).collect():
        raise SchemaError(f"{source}: {found[0]['problem']}, first ones {[r['entity_id'] for r in found]}")
    return df


def read_source(spark: SparkSession, path: str, check: bool = True, quoted_breaks: bool = False) -> DataFrame:
    df = _tsv(spark, path, SOURCE, quoted_breaks)
    return check_source(df, path) if check else df


def read_sources(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The three sources of a training or test folder."""
    return {name: read_source(spark, f"{folder}/{file}") for name, file in (files or FILES).items()}


def parse_ids(ids: Column) -> Column:
    """Distinct non-blank ids of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ",", -1), lambda v: F.trim(v)), lambda v: v != ""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, matched (array of ids); ids must start with their source's name."""
    df = _tsv(spark, path, TRUTH).select("source1_entity_id", parse_ids(F.col("matched_entity_ids")).alias("matched"))
    if df.isEmpty():
        raise SchemaError(f"{path}: no rows")
    wrong = ~F.col("source1_entity_id").startswith("S1-") | F.exists("matched", lambda v: ~(v.startswith("S2-") | v.startswith("S3-")))
    if bad := df.where(wrong).limit(10).collect():
        raise SchemaError(f"{path}: ids of other sources, first rows {[tuple(r) for r in bad]}")
    twice = df.groupBy("source1_entity_id").count().where("count > 1").limit(10).collect()
    if twice:
        raise SchemaError(f"{path}: repeated {[r[0] for r in twice]}")
    return df


def read_positive_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, candidate_entity_id, label 1 of every listed match; `-` and blanks list none."""
    ids = F.explode(F.filter(F.transform(F.split("matched_entity_ids", ",", -1), lambda v: F.trim(v)), lambda v: ~v.isin("", "-")))
    pairs = _tsv(spark, path, TRUTH).where(F.trim("source1_entity_id") != "").select(F.trim("source1_entity_id").alias("source1_entity_id"), ids.alias("candidate_entity_id"))
    return pairs.withColumn("label", F.lit(1))


def read_parquet(spark: SparkSession, *paths: str, view: str | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    if view:
        df.createOrReplaceTempView(view)
    return df


def numbered_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Rows of one text file with their place in it, from 0.

    A large file is read by several tasks, each of them one or more pieces of it; numbers of rows rise inside a piece,
    so a row's place is that in its piece after the rows of all pieces before.
    """
    rows = df.select("*", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = rows.groupBy("_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row a piece
    before = F.sum("_n").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(pieces), "_start").select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(name))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """A one-row JSON artifact."""
    row = spark.read.json(path).first()
    return row.asDict(recursive=True) if row else {}


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """A written match or candidate list, without quoting rules, to verify it."""
    return spark.read.options(sep="\t", header=True, quote="", escape="").csv(path).na.fill("")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n least rows by key: files have no row order in a cluster."""
    return df.orderBy(key).limit(n)

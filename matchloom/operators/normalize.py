"""Records with normalized names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SOURCE, SchemaError


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"missing columns: {missing}")


def with_name(df: DataFrame, mode: str = "portable") -> DataFrame:
    norm = df.withColumn("name_raw", text.present(F.col("business_name"))).withColumn("name_norm", text.normalize_name(F.col("business_name"), mode))
    return norm.withColumn("name_compact", text.compact(F.col("name_norm"))).withColumn("name_tokens", text.tokens(F.col("name_norm")))


def with_address(df: DataFrame, mode: str = "portable") -> DataFrame:
    norm = df.withColumn("address_raw", text.present(F.col("business_address"))).withColumn("address_norm", text.normalize_address(F.col("business_address"), mode))
    out = norm.withColumn("address_compact", text.compact(F.col("address_norm"))).withColumn("address_tokens", text.tokens(F.col("address_norm")))
    return out.withColumn("address_numbers", text.numbers(F.col("address_norm")))


def normalize(df: DataFrame, mode: str = "portable") -> DataFrame:
    """All 13 columns of a normalized record in one projection."""
    require(df, SOURCE.fieldNames())
    return with_address(with_name(df.withColumn("country", text.present(F.col("country"))), mode), mode)


def targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """S2 and S3 together, keyed by candidate_entity_id and tagged with their source."""
    tagged = [df.withColumnRenamed("entity_id", "candidate_entity_id").withColumn("candidate_source", F.lit(tag)) for df, tag in ((s2, "S2"), (s3, "S3"))]
    return tagged[0].unionByName(tagged[1])

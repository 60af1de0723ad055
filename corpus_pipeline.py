"""A training corpus from `documents` in five stages, each on what the one before it kept.

Documents that the quality classifier rejects go; of every group of near-duplicates one stays; secrets in texts are
masked; sources are mixed to their target weights, a document standing there as often as the mix takes it; and all is
packed into sequences. The stages train models and pack by linear programs, so no SQL gives these rows; the tests hold
each stage against a brute-force version.

Cases: rows with a null doc_id are kept, mixed and packed one by one, by their texts; null and empty texts are scored as
empty, are near-duplicates of each other, have no secrets and size 0, so the mix takes all or none of them, and make one
piece that holds the end id; rows with one doc_id and unlike texts share a component id, so near-dedup keeps one of them;
repeated rows are copies of each other; a null source is a source of its own; very long texts pass every stage whole; an
empty table, or one that a stage empties, gives no rows; without labels of both classes the classifier keeps or rejects
all rows by the share of label 1; other columns, whatever their names, travel along up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import mixing, near_dup, packing, quality, secrets
from matchloom.llm.common import discard, documents, scratch, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is a written table; what a stage wrote on its way, and the table it read, are deleted then."""
    docs, read = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs, path = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
            kept.add(path)
        discard(spark, read)
        read = [path]
    return docs

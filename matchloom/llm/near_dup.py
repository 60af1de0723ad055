r"""Operator 2, SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit that over half of the 64-bit hashes of a text's 3-word shingles have. Two
fingerprints link at `RADIUS` = 2 or fewer differing bits. Every distinct fingerprint emits the ball of half that radius
around it: itself and the 64 variants with one bit flipped. Two fingerprints are within 2 bits of each other if and only
if their balls meet, so a shuffle by variant finds every link. All that meet in a variant are within one bit of it: at
most 65 distinct fingerprints, however many documents have them. They are chained in order, which connects what all
pairs would, and each link of the chain is verified by its differing bits.

Cases: null and empty texts have no words and the fingerprint zero, and link like any other; texts of one or two words
are one shingle; repeated rows and equal texts share a fingerprint; equal doc_ids get a row each; a component's id is its
smallest doc_id that isn't null, or null if there is none; an empty table gives no rows; a very long text is read whole,
its shingles a few thousand at a time; other columns are not read by `group`. `keep_one` returns one row for each component, the first of those with its id, and of a component without any id
one row; components that share an id have one row together. It returns all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ascii_lower, documents, materialize, slices
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text."""
    import xxhash

    words = ascii_lower(text or "").split()  # bytes.split() splits at \x20 and \x09-\x0D alone
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return int.from_bytes(digest(b" ".join(words), SEED), "big", signed=True)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[start : start + (1 << 14)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp` within the radius."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)])
    ball = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = ball.select("fp", before.alias("other")).where("other is not null").distinct()
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp for each row; and fp, root, component_id for each distinct fingerprint."""
    marked = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, labelled.join(least, "root").select("fp", "root", "component_id")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    marked, named = _named(docs)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rows_without_id(docs: DataFrame) -> DataFrame:
    """row, fp for each row without doc_id."""
    chosen = docs.where("doc_id is null").select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["row", "fp"])

    return chosen.mapInArrow(run, StructType([chosen.schema["row"], StructField("fp", LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    marked, named = _named(docs)
    chosen = marked.join(named, "fp").where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row")).withColumn("id", F.col("row")["doc_id"])
    kept = rows.join(chosen, "id", "left_semi")
    lone = _rows_without_id(docs).join(named.where("component_id is null"), "fp").select("row", F.col("root").alias("id"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row")))
    one = lambda df: df.withColumn("n", first).where("n = 1").select("row.*")
    return one(kept).unionByName(one(lone))


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(documents(spark, sf_dir))

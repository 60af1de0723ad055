"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import GIVEN, discard, scratch, shared_dir, staged
from ..sources.scratch import folder as stage_path
from ..sources.scratch import written as materialize

__all__ = ["GIVEN", "ascii_lower", "discard", "documents", "materialize", "scratch", "shared_dir", "slices", "stage_path", "staged", "table", "words"]

#: The white space that separates words wherever a contract says `[^\x20\x09-\x0D]+`.
SPACES = "\t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs `[^\x20\x09-\x0D]+` of a text; null text gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " ", -1), "")


def ascii_lower(text: str) -> bytes:
    """UTF-8 of a text with A-Z alone in lower case (bytes.lower leaves all other bytes)."""
    return text.encode("utf-8", "surrogatepass").lower()


#: Rows and bytes of an Arrow batch that a Python worker handles at once; a single larger row is a slice of its own.
SLICE = 1536
SLICE_BYTES = 32 << 20


def _parts(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = rows if batch.num_rows > rows else batch.num_rows // 2
        yield from _parts(batch.slice(0, half), rows, size)
        for start in range(half, batch.num_rows, half):
            yield from _parts(batch.slice(start, half), rows, size)
    else:
        yield batch


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches; in the end the worker, which waits for its next task, gives unused memory back."""
    for batch in batches:
        yield from _parts(batch, rows, size)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass

"""Written tables that cut a plan: Parquet in the folder of `spark.checkpoint.dir`, which driver and executors share.

Results are read lazily from such tables, so those that nobody deletes before go when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schema import LinkageError

#: Paths that were given out and not deleted yet, with the gateway to the JVM that can delete them.
GIVEN: dict[str, Any] = {}

#: Lets Spark remove the shuffle files of a query at its end instead of at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which the driver and all executors see.

    A local session that names none (unit tests in one JVM) gets a folder of its own; on a cluster, where no other
    machine would see such a folder, this raises LinkageError.
    """
    context = spark.sparkContext
    got = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not got:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise LinkageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
        context.setCheckpointDir(got)
    return got.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    GIVEN[path] = spark.sparkContext._gateway
    return path


def _delete(path: str, gateway: Any) -> None:
    where = gateway.jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete what nothing reads any more."""
    for path in paths:
        if GIVEN.pop(path, None) is not None:
            _delete(path, spark.sparkContext._gateway)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Delete on leaving, by an error too, all that was written inside but the paths added to the given set."""
    before, kept = set(GIVEN), set()
    try:
        yield kept
    finally:
        discard(spark, [path for path in GIVEN if path not in before | kept])


@atexit.register
def _delete_the_rest() -> None:
    for path, gateway in GIVEN.items():
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(path, gateway)


def staged(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """`df` written as Parquet into the shared folder and read back, and where it is.

    Unlike an eager checkpoint() this computes `df` once, keeps it columnar, and survives lost executors. Once the table
    is written nothing reads the shuffle files behind it, so they go at once.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: `df` as a written table."""
    return staged(df, label)[0]

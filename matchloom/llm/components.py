"""Connected components by alternating large and small stars, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Edges to a partition, so that small rounds don't write hundreds of tiny files.
EDGES_A_PARTITION = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them.

    The least neighbour is a partial minimum, joined back: a join that can be split, so a hub with a third of all
    edges is not one task's work.
    """
    around = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least.withColumn("m", F.least("u", "m")), "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.least("u", "m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (u long, v long) that isn't itself the least of its component.

    Both stars keep components; the rounds end when a round changes nothing, after about log(diameter) of them. Every
    round is written to the shared folder, so plans stay short and lost executors cost one round; the round before it is
    deleted then.
    """

    spark = edges.sparkSession

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current, at = staged(edges.where("u <> v").select("u", "v"), "edges")
    before = stamp(current)
    while before[0]:
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + before[0] // EDGES_A_PARTITION)
        current, following = staged(_star(_star(current, True), False).coalesce(parts), "stars")
        discard(spark, [at])
        at, after = following, stamp(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Incremental linkage: arriving S1 records against static targets.

Every micro-batch is normalized, blocked and scored with the batch operators (a stateless stream-static join), so its
rows are those of a batch run over the same records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, ranking
from ..operators.normalize import normalize
from ..schema import SOURCE


def read_source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated files of a folder as they arrive."""
    return spark.readStream.schema(SOURCE).options(sep="\t", header=True, quote='"', escape='"').csv(folder).na.fill("")


def link_batch(batch: DataFrame, targets: DataFrame, k: int = 10, cap: int = 100) -> DataFrame:
    """The k best candidates of each record of a batch of raw records."""
    s1 = normalize(batch)
    return ranking.top_k(ranking.score_pairs(blocking.six_rules(s1, targets, cap), s1, targets, ranking.jaccard_score()), k)


def link_stream(stream: DataFrame, targets: DataFrame, out: str, checkpoint: str, *, k: int = 10, cap: int = 100, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write each batch's candidates to `out/batch=<id>`; a repeated batch overwrites itself, so results are exactly once."""

    def run(batch: DataFrame, number: int) -> None:
        found = link_batch(batch, targets, k, cap)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(batch.sparkSession.read.parquet(f"{out}/batch={number}"), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .license_scan import op6_license_scans
from .lm_score import op4_lm_scoring
from .media import op7_media_columns
from .mixing import op10_mixing
from .near_dup import op2_simhash_near_dup
from .packing import op3_best_fit_packing
from .quality import op1_quality_classifier
from .rules import op9_quality_rules
from .secrets import op8_secret_scans
from .sql import SQL as PLAIN_SQL
from .sql import lm_scores
from .wavelet import op5_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dup": op2_simhash_near_dup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_shards": op5_token_shards,
    "op6_license_scans": op6_license_scans,
    "op7_media_columns": op7_media_columns,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = PLAIN_SQL | {"op4_lm_scoring": lm_scores()}

__all__ = ["QUERIES", "SQL"]

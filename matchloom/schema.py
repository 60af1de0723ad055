"""Schemas and error types of business records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of every raw source, all text; missing values are empty strings.
SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
PAIR = ("source1_entity_id", "candidate_entity_id")
BLOCKERS = ("exact", "rare_token", "numeric", "tfidf", "dense")


class LinkageError(ValueError):
    """Any input that an operator refuses."""


class SchemaError(LinkageError):
    """Columns are missing or rows break a constraint of their table."""


class NotFittedError(RuntimeError):
    """A model is used before it is trained."""

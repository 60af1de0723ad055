r"""Normalization of names and addresses as column expressions.

Two modes: `portable` stays in the JVM (lower case, sharp s as ss), `full` adds NFKC and Unicode case folding through
an Arrow UDF, as Spark has neither.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Unicode-aware word characters are, spelled so that Java and RE2 agree.
OTHER = r"[^\p{L}\p{N}_\s'-]"
TOKEN = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
#: Fixed value: the numbers of a raw text.
RAW_NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
#: Whole-token abbreviations of streets.
ABBREVIATIONS = {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "ln": "lane"}


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def present(text: Column) -> Column:
    """Text without the null that a missing value may have become."""
    return F.coalesce(text.cast("string"), F.lit(""))


def normalize_name(text: Column, mode: str = "portable") -> Column:
    if mode not in ("portable", "full"):
        raise ValueError(f"mode {mode!r}")
    folded = _nfkc_casefold(present(text)) if mode == "full" else F.replace(F.lower(present(text)), F.lit("ß"), F.lit("ss"))
    return strip(F.regexp_replace(F.regexp_replace(folded, OTHER, " "), r"\s+", " "))


def expand_abbreviations(normalized: Column) -> Column:
    def expand(token: Column) -> Column:
        out = token
        for short, long in ABBREVIATIONS.items():
            out = F.when(token == short, long).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(normalized, " ", -1), expand), " ")


def normalize_address(text: Column, mode: str = "portable") -> Column:
    return expand_abbreviations(normalize_name(text, mode))


def compact(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit(""))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def numbers(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(NUMBER), F.lit(0))


def raw_numbers(text: Column) -> Column:
    """Numbers of a raw text, where a record has no extracted ones: only a point divides whole and part."""
    return F.regexp_extract_all(strip(present(text)), F.lit(RAW_NUMBER), F.lit(0))

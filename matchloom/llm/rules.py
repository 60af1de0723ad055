r"""Operator 9, quality rules in DataFrame expressions alone.

Base figures are computed in one projection of a document's own text. The method looks across documents: every
\n-separated line is normalised (lower case, digits as 0, runs of white space as one blank) and hashed; a line's count is
the number of different texts of its host (`source`) that have it, so exact copies count once. A line above
`max(MIN_DOCS, SHARE of the host's texts)` is boilerplate and is removed; a document that keeps less than `LEAST_KEPT` of
its characters is depleted and rejected.

Hot lines are counted in partial sums, and the join of lines with boilerplate can be split; no group is collected.

Cases: null and empty texts have no words and so fail the base rule; a null source is a host of its own; equal rows get
equal verdicts; a null doc_id is a key like any other; an empty table gives no rows; a very long text is judged whole, its
windows sorted in n log n steps; other columns are not read by `apply_rules` and kept by `without_boilerplate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, words
from .secrets import let

MIN_DOCS = 20
SHARE = 0.05
LEAST_KEPT = 0.2
SYMBOLS = "[#*$%&|<>]"


def repeated_words(hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more; `hashes` has one 64-bit hash per word."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))

    def covered(sorted_windows: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(sorted_windows, lambda x, i: same(x, F.get(sorted_windows, i + 1)) | same(x, F.get(sorted_windows, F.when(i > 0, i - 1))))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        unlike = F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) == F.size(w)
        return F.when(unlike, F.lit(0)).otherwise(let(F.array_sort(w), covered))

    return let(let(hashes, windows), counted)


def base_rules(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "source", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = split.select(
        "doc_id",
        "source",
        F.xxhash64(text).alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.transform("w", lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\p{Nd}+", "0"), r"[\x20\x09-\x0D]+", " ")))


def _line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, line (hash of the normalised line), chars of each line that isn't blank, as a table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.length(F.trim(x)).alias("chars")))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.explode(lines).alias("l")).select("doc_id", "source", "text_hash", "l.line", "l.chars")
    return materialize(rows.where("chars > 0"), "lines")


def _hits(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """The rows whose line is above the limit of its host."""
    hosts = rows.groupBy("source").agg(F.count_distinct("text_hash").alias("texts"))
    counted = rows.groupBy("source", "line").agg(F.count_distinct("text_hash").alias("n")).where(F.col("n") > min_docs)
    same_host = counted["source"].eqNullSafe(hosts["source"])
    above = counted.join(hosts, same_host).where(F.col("n") > F.lit(share) * F.col("texts")).select(counted["source"].alias("host"), F.col("line").alias("common"))
    return rows.join(above, rows["source"].eqNullSafe(above["host"]) & (rows["line"] == above["common"]))


def depletion(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """For each (doc_id, source, text_hash) that has lines above the limit: characters of all lines, and of those removed."""
    rows = _line_rows(docs)
    lost = _hits(rows, min_docs, share).groupBy("doc_id", "source", "text_hash").agg(F.sum("chars").alias("lost"))
    total = rows.groupBy("doc_id", "source", "text_hash").agg(F.sum("chars").alias("chars"))
    return _keyed(total, lost, "inner").select(*[F.col(f"l.{c}") for c in KEY], "chars", "lost")


def without_boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """`docs`, with all columns, their `text` without the lines above the limit of its host; a text that has none stays as it is."""
    found = _hits(_line_rows(docs), min_docs, share).groupBy(*KEY).agg(F.collect_set("line").alias("common"))  # lines of one document
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    left = F.filter(F.split(F.col("l.row")["text"], "\n", -1), lambda x: ~F.array_contains("r.common", F.xxhash64(normal_line(x))))
    text = F.when(F.col("r.common").isNull(), F.col("l.row")["text"]).otherwise(F.array_join(left, "\n"))
    return _keyed(rows, found, "left").select(*[text.alias(c) if c == "text" else F.col("l.row")[c].alias(c) for c in docs.columns])


KEY = ("doc_id", "source", "text_hash")


def _keyed(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    a, b = left.alias("l"), right.alias("r")
    on = F.col("l.text_hash") == F.col("r.text_hash")
    for c in ("doc_id", "source"):
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return a.join(b, on, how)


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The base figures of each document, base_failed, kept, and the share of characters that boilerplate takes."""
    joined = _keyed(base_rules(docs), depletion(docs, min_docs, share), "left")
    gone = F.coalesce(F.col("r.lost") / F.col("r.chars"), F.lit(0.0))
    kept = ~F.col("l.base_failed") & (gone <= 1 - least_kept)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in names], kept.alias("kept"), gone.alias("boilerplate_share"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))

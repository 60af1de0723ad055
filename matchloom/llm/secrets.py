r"""Operator 8, secret scans by pattern and by randomness, in DataFrame expressions alone (no shuffle, no Python).

Base spans come from three patterns (see `KINDS`). The method adds spans of kind `random`: every run of 20 or more
characters of `[A-Za-z0-9+/_=-]` that no base span overlaps is a candidate. From its characters an encoding is inferred,
with an alphabet of k symbols, and a battery tests whether it looks uniform over that alphabet: chi-squared (Wilson-
Hilferty), runs above and below the middle, and lag-1 serial correlation, with a Bonferroni bound. Whether it may be
ordinary text instead is a second hypothesis: text repeats symbols with a known index of coincidence, so its chi-squared
statistic is non-central, and the more so the longer the run is. The p-values of that hypothesis go through the
Benjamini-Hochberg procedure over a document's candidates at rate `FDR`; short runs have no power and so are not found.

Cases: null or empty text has no spans (their digest is that of the empty string); equal rows give equal rows; an empty
table gives no rows; a very long text is scanned whole, in a time that its length and matches take times their logarithm;
other columns, whatever their names, are not read by `scan`, and are kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Patterns and shortest lengths of the contract, fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
UNIFORM_LEVEL = 0.01
FDR = 0.05
#: Encodings by pattern, with their alphabets in order and the index of coincidence of ordinary runs in them. Characters
#: outside the alphabet (padding, a prefix that ends in `=`) count as one more symbol, which the alphabet's size leaves out.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.14),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.12),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.068),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.068),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.068),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.062),
    ("base64url", "^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.062),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.062),
)

Span = "array<struct<start:int,rank:int,end:int,body:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Totals of an array up to each place, by doubling: n log n steps, as an aggregate that appends would take n * n."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values))))

    def doubled(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= step, combine(x, F.coalesce(F.get(acc, i - step), x))).otherwise(x))

    return F.aggregate(rounds, values, doubled)


def matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All leftmost matches as (start, rank, end, body), in code points: the gaps between them are what split() leaves."""
    regex = F.lit(pattern)
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("body"),
    )

    def placed(x: Column) -> Column:
        steps = F.transform(x["whole"], lambda w, i: F.length(w) + F.length(F.get(x["gaps"], i)))

        def rows(ends: Column) -> Column:
            def row(w: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.length(w)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.get(x["body"], i).alias("body"))

            return F.transform(x["whole"], row)

        return let(let(steps, lambda v: running(v, lambda a, b: a + b)), rows)

    none = F.array().cast(Span)
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by a logistic approximation good to 2e-4."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _of_encoding(body: Column, pick: Callable[[tuple], Column]) -> Column:
    chosen = pick(ENCODINGS[-1])
    for encoding in reversed(ENCODINGS[:-1]):
        chosen = F.when(body.rlike(encoding[1]), pick(encoding)).otherwise(chosen)
    return chosen


def battery(body: Column) -> Column:
    """Struct of `uniform` (p-value of uniform symbols) and `ordinary` (p-value of ordinary text)."""
    alphabet = _of_encoding(body, lambda e: F.lit(e[2]))
    coincidence = _of_encoding(body, lambda e: F.lit(e[3]))
    folded = F.when(body.rlike(ENCODINGS[1][1]), F.lower(body)).otherwise(body)

    def tested(x: Column) -> Column:
        v, k, n = x["v"], x["k"].cast("double"), F.size(x["v"]).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(v, lambda c: c == d)).cast("double"), F.lit(2.0)))
        following = F.slice(v, F.lit(2), F.size(v) - 1)
        leading = F.slice(v, F.lit(1), F.size(v) - 1)
        middle = (k - 1) / 2
        changes = F.aggregate(F.zip_with(leading, following, lambda a, b: ((a > middle) != (b > middle)).cast("double")), F.lit(0.0), lambda acc, c: acc + c)
        lagged = F.aggregate(F.zip_with(leading, following, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda acc, c: acc + c)

        def verdict(s: Column) -> Column:
            df, chi = k - 1, k / n * s["squares"] - n
            spread = 2 / (9 * df)
            z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
            z_runs = (s["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            z_serial = s["lagged"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
            uniform = F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))))
            excess = n * F.greatest(k * x["ic"] - 1, F.lit(0.0))
            ordinary = upper_tail((df + excess - chi) / F.sqrt(2 * (df + 2 * excess)))
            return F.struct(uniform.alias("uniform"), ordinary.alias("ordinary"))

        return let(F.struct(squares.alias("squares"), changes.alias("changes"), lagged.alias("lagged")), verdict)

    def coded(e: Column) -> Column:
        values = F.transform(F.regexp_extract_all(e["body"], F.lit("."), F.lit(0)), lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
        return let(F.struct(values.alias("v"), F.length(e["alphabet"]).alias("k"), e["ic"].alias("ic")), tested)

    return let(F.struct(folded.alias("body"), alphabet.alias("alphabet"), coincidence.alias("ic")), coded)


def random_spans(text: Column, base: Column) -> Column:
    """Candidates that pass the battery and the false-discovery control of their document."""

    def chosen(candidates: Column) -> Column:
        judged = lambda c: let(battery(c["body"]), lambda b: F.struct(b["ordinary"].alias("p"), b["uniform"].alias("uniform"), c.alias("span")))
        scored = F.array_sort(F.transform(candidates, judged))

        def controlled(rows: Column) -> Column:
            m = F.size(rows).cast("double")
            last = F.aggregate(F.transform(rows, lambda r, i: F.when(r["p"] <= (i + 1) * FDR / m, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
            found = F.filter(rows, lambda r, i: (i < last) & (r["uniform"] >= UNIFORM_LEVEL))
            return F.transform(found, lambda r: r["span"])

        return let(scored, controlled)

    none = F.array().cast(Span)
    free = let(F.struct(base.alias("base"), matches(text, CANDIDATE, 3).alias("found")), lambda x: _apart(x["found"], x["base"]))
    return F.when(text.rlike(CANDIDATE), let(free, lambda c: F.when(F.size(c) > 0, chosen(c)).otherwise(none))).otherwise(none)


def _apart(spans: Column, base: Column) -> Column:
    """Those of `spans` that overlap none of `base`, which is in order of start: a binary search for each."""
    known = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), running(F.transform(base, lambda b: b["end"]), F.greatest).alias("ends"))

    def apart(x: Column) -> Column:
        bits = F.sequence(F.length(F.bin(F.size(x["starts"]))), F.lit(0))

        def free(c: Column) -> Column:
            def lower(at: Column, k: Column) -> Column:
                step = F.call_function("shiftleft", F.lit(1), k)
                return F.when(F.coalesce(F.get(x["starts"], at + step - 1) < c["end"], F.lit(False)), at + step).otherwise(at)

            before = F.aggregate(bits, F.lit(0), lower)  # base spans that start before its end
            return ~F.coalesce(F.get(x["ends"], before - 1) > c["start"], F.lit(False))

        return F.filter(spans, free)

    return F.when((F.size(base) > 0) & (F.size(spans) > 0), let(known, apart)).otherwise(spans)


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda m: F.length(m["body"]) >= SHORTEST_VALUE)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2)))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of each document."""
    based = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    full = based.select("doc_id", "base", F.array_sort(F.concat("base", random_spans(F.col("text"), F.col("base")))).alias("all"))

    def number(rank: int) -> Column:
        return F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [number(rank) for rank in range(len(KINDS))]
    return full.select("doc_id", *counts[:3], F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"), counts[3])


#: Code points of a block of text: a substring is found by counting from the start of its block, not of the text.
BLOCK = 4096


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """`text` with what spans (in order of start) cover as `mark`, overlapping ones as one, in linear time."""

    def parts(x: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            piece = lambda k: F.substring(F.get(x["blocks"], k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.floor((b - 1) / BLOCK).cast("int")), piece), "")).otherwise("")

        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
            return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mark))).otherwise("")

        last = between(F.element_at(x["ends"], -1), x["length"])
        return F.concat(F.array_join(F.transform(spans, part), ""), last)

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), ends.alias("ends"), F.length(text).alias("length")), parts)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with every found span replaced in `text`; all other columns but `n_chars`, which follows, stay as they are."""
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("row"))
    based = row.withColumn("text", F.coalesce(F.col("row")["text"], F.lit(""))).withColumn("base", base_spans(F.col("text")))
    full = based.select("row", "text", F.array_sort(F.concat("base", random_spans(F.col("text"), F.col("base")))).alias("all"))
    cleaned = _masked(F.col("text"), F.col("all"), mark)
    done = full.select("row", F.when(F.size("all") > 0, cleaned).otherwise(F.col("row")["text"]).alias("clean"), (F.size("all") > 0).alias("changed"))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return done.select(*out)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

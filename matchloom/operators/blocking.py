"""Candidate generation by shared keys: equi-joins of exploded keys, capped before they pair.

A key's frequency is its number of targets. Keys above the cap are dropped from the target side by a semi-join with the
capped frequency table, so no hot key reaches the pairing join; frames carry ids only, records join after pruning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import clean_tokens
from ..schema import PAIR, LinkageError

EXACT_FIELDS = ("name_norm", "name_compact", "address_norm", "address_compact")
TOKEN_FIELDS = ("name_tokens", "address_tokens")


def usable(key: Column) -> Column:
    return key.isNotNull() & (F.regexp_replace(key, r"\s+", "") != "")


def key_frequency(targets: DataFrame, key: str) -> DataFrame:
    """key, frequency: rows of targets with a non-empty key."""
    return targets.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("frequency"))


def element_frequency(targets: DataFrame, column: str, name: str = "element") -> DataFrame:
    """element, frequency: targets that hold the element, once each."""
    return elements(targets, "candidate_entity_id", column, name).groupBy(name).agg(F.count(F.lit(1)).alias("frequency"))


def elements(df: DataFrame, key: str, column: str, name: str = "element") -> DataFrame:
    """One row per record and distinct element: distinct inside the row, so nothing is shuffled for it."""
    return df.select(key, F.explode(F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))).alias(name)).where(F.col(name) != "")


def _ids(s1: DataFrame) -> DataFrame:
    return s1.withColumnRenamed("entity_id", "source1_entity_id")


def pair_by_keys(s1: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that agree on all keys, none of them empty; not capped."""
    full = reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys])
    left, right = _ids(s1).where(full).select(PAIR[0], *keys), targets.where(full).select(PAIR[1], *keys)
    return left.join(right, keys).select(*PAIR)


def pair_by_rare_key(s1: DataFrame, targets: DataFrame, key: str, cap: int, also: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """Pairs that agree on a key of at most `cap` targets (of `counted`, if given), and on the columns in `also`."""
    rare = key_frequency(targets if counted is None else counted, key).where(F.col("frequency") <= cap).select(key)
    right = targets.select(PAIR[1], key, *also).join(rare, key, "left_semi")
    return _ids(s1).where(F.col(key) != "").select(PAIR[0], key, *also).join(right, [key, *also]).select(*PAIR)


def pair_by_rare_element(s1: DataFrame, targets: DataFrame, column: str, cap: int) -> DataFrame:
    """Distinct pairs that share an element of at most `cap` targets."""
    held = elements(targets, PAIR[1], column)
    rare = held.groupBy("element").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") <= cap).select("element")
    right = held.join(rare, "element", "left_semi")
    return elements(_ids(s1), PAIR[0], column).join(right, "element").select(*PAIR).distinct()


def three_rules(s1: DataFrame, targets: DataFrame, cap: int = 20, counted: DataFrame | None = None) -> DataFrame:
    """Same name and address, or a rare name, or a rare address; `counted` are the targets that frequencies count, if others."""
    rare = [pair_by_rare_key(s1, targets, c, cap, counted=counted) for c in ("name_compact", "address_compact")]
    rules = [pair_by_keys(s1, targets, ["name_compact", "address_compact"]), *rare]
    return reduce(DataFrame.union, rules).distinct()


def six_rules(s1: DataFrame, targets: DataFrame, cap: int = 100, max_candidates: int | None = None) -> DataFrame:
    """The three rules, or a shared rare name token, address token or number."""
    more = [pair_by_rare_element(s1, targets, c, cap) for c in ("name_tokens", "address_tokens", "address_numbers")]
    return guard(reduce(DataFrame.union, [three_rules(s1, targets, cap), *more]).distinct(), max_candidates)


def guard(pairs: DataFrame, max_candidates: int | None) -> DataFrame:
    if max_candidates is not None and (n := pairs.count()) > max_candidates:
        raise LinkageError(f"{n} candidates, {max_candidates} allowed")
    return pairs


def rule_matches(s1: DataFrame, targets: DataFrame, candidates: DataFrame, cap: int = 3) -> DataFrame:
    """Model-free matches among the candidates: name and address, or a rare name or rare address in the same country."""
    rules = [pair_by_keys(s1, targets, ["name_compact", "address_compact"]), pair_by_rare_key(s1, targets, "name_compact", cap, ("country",)), pair_by_rare_key(s1, targets, "address_compact", cap, ("country",))]
    return reduce(DataFrame.union, rules).distinct().join(candidates.select(*PAIR), list(PAIR), "left_semi")


# The library's blockers give the long form: pair, source, blocker, evidence, rank, score.


def _long(pairs: DataFrame, targets: DataFrame, blocker: str, rank: Column, score: Column) -> DataFrame:
    sources = targets.select(PAIR[1], F.col("candidate_source").alias("source"))
    return pairs.join(sources, PAIR[1]).select(*PAIR, "source", F.lit(blocker).alias("blocker"), "evidence", rank.cast("int").alias("rank"), score.cast("double").alias("score"))


def _by_id() -> Column:
    return F.row_number().over(Window.partitionBy(PAIR[0]).orderBy(PAIR[1]))


def exact_blocker(s1: DataFrame, targets: DataFrame, fields: tuple[str, ...] = EXACT_FIELDS, max_frequency: int = 100) -> DataFrame:
    """Pairs equal in any field whose value at most `max_frequency` targets have; evidence are the fields."""
    if max_frequency < 1:
        raise LinkageError("max_frequency must be positive")

    def melt(df: DataFrame, key: str) -> DataFrame:
        stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
        return df.select(key, F.explode(stacked).alias("x")).select(key, "x.field", "x.value").where(usable(F.col("value")))

    held = melt(targets, PAIR[1])
    rare = held.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_frequency).select("field", "value")
    met = melt(_ids(s1), PAIR[0]).join(held.join(rare, ["field", "value"], "left_semi"), ["field", "value"])
    pairs = met.groupBy(*PAIR).agg(F.array_sort(F.collect_set("field")).alias("evidence"))
    return _long(pairs, targets, "exact", F.lit(None), F.lit(None))


def rare_token_blocker(s1: DataFrame, targets: DataFrame, fields: tuple[str, ...] = TOKEN_FIELDS, max_token_frequency: int = 100, max_tokens_per_record: int = 5) -> DataFrame:
    """Pairs that share, in the same field, one of the record's rarest tokens; evidence are the tokens, rank the place by id."""
    if max_token_frequency < 1 or max_tokens_per_record < 1:
        raise LinkageError("limits must be positive")

    def melt(df: DataFrame, key: str) -> DataFrame:
        stacked = F.array(*[F.struct(F.lit(f).alias("field"), clean_tokens(F.col(f)).alias("tokens")) for f in fields])
        return df.select(key, F.explode(stacked).alias("x")).select(key, "x.field", F.explode("x.tokens").alias("token"))

    held = melt(targets, PAIR[1])
    rare = held.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_token_frequency)
    order = Window.partitionBy(PAIR[0], "field").orderBy("n", "token")
    chosen = melt(_ids(s1), PAIR[0]).join(rare, ["field", "token"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_tokens_per_record)
    met = chosen.select(PAIR[0], "field", "token").join(held, ["field", "token"])
    pairs = met.groupBy(*PAIR).agg(F.array_sort(F.collect_set("token")).alias("evidence"))
    return _long(pairs, targets, "rare_token", _by_id(), F.lit(None))


def numeric_blocker(s1: DataFrame, targets: DataFrame, field: str = "address_numbers", max_frequency: int = 100) -> DataFrame:
    """Pairs that share a number of at most `max_frequency` targets; evidence are the numbers, rank the place by id."""
    if max_frequency < 1:
        raise LinkageError("max_frequency must be positive")
    held = elements(targets, PAIR[1], field)
    rare = held.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_frequency).select("element")
    met = elements(_ids(s1), PAIR[0], field).join(held.join(rare, "element", "left_semi"), "element")
    pairs = met.groupBy(*PAIR).agg(F.array_sort(F.collect_set("element")).alias("evidence"))
    return _long(pairs, targets, "numeric", _by_id(), F.lit(None))


def candidate_union(*blocked: DataFrame, check_sources: bool = False) -> DataFrame:
    """One row per pair: source, sorted provenance, ranks by blocker, num_blockers, best_rank."""
    if not blocked:
        raise LinkageError("nothing to unite")
    columns = [*PAIR, "source", "blocker", "rank"]
    rows = reduce(DataFrame.unionByName, [b.select(*columns) for b in blocked])
    per_blocker = rows.groupBy(*PAIR, "blocker").agg(F.min("rank").alias("rank"), F.min("source").alias("least"), F.max("source").alias("most"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("blocker", "rank"))))
    out = per_blocker.groupBy(*PAIR).agg(F.min("least").alias("source"), F.max("most").alias("most"), F.array_sort(F.collect_set("blocker")).alias("blocker_provenance"), F.map_from_entries(ranked).alias("ranks"))
    if check_sources and (bad := out.where("source <> most").limit(1).collect()):
        raise LinkageError(f"two sources for {tuple(bad[0])[:2]}")
    return out.drop("most").withColumn("num_blockers", F.size("blocker_provenance")).withColumn("best_rank", F.array_min(F.map_values("ranks")))


# Prefix blocking


#: Records of S1 that one share of a beginning holds; its targets stand in each share.
SHARE = 1000


def _beginnings(df: DataFrame, id_column: str, lengths: dict[str, int], rare: dict[str, DataFrame] | None = None) -> DataFrame:
    """id, name and address: of every id its pairs of country and beginning, one each unless the id stands in several rows."""
    rows = df.where(F.col("country") != "").select(id_column, "country", *[F.when(F.col(c) != "", F.left(F.col(c), F.lit(n))).alias(c) for c, n in lengths.items()])
    for column, kept in (rare or {}).items():
        rows = rows.join(kept.withColumn("kept", F.lit(True)), column, "left").withColumn(column, F.when(F.col("kept"), F.col(column))).drop("kept")
    return rows.groupBy(id_column).agg(*[F.array_sort(F.collect_set(F.when(F.col(c).isNotNull(), F.concat("country", F.lit("\0"), c)))).alias(c) for c in lengths])


def prefix_pairs(s1: DataFrame, targets: DataFrame, name_prefix: int = 5, address_prefix: int = 8, frequency_cap: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Same country, and the same beginning of the compact name or address; optionally only beginnings that are rare.

    A pair is made once, by the first beginning that it shares, so pairs aren't shuffled to be distinct. Beginnings of
    many records are dealt to several tasks. `counted` are the targets that frequencies count, if others.
    """
    all_targets = targets if counted is None else counted
    lengths = {"name_compact": name_prefix, "address_compact": address_prefix}
    rare = None
    if frequency_cap is not None:  # the frequency counts all targets, of every country
        rare = {c: all_targets.where(F.col(c) != "").groupBy(F.left(F.col(c), F.lit(n)).alias(c)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= frequency_cap).select(c) for c, n in lengths.items()}
    left, right = _beginnings(_ids(s1), PAIR[0], lengths), _beginnings(targets, PAIR[1], lengths, rare)

    def pairs(key: str, earlier: str | None) -> DataFrame:
        others = [key] if earlier is None else [key, earlier]
        a = left.select(PAIR[0], F.explode(key).alias("at"), *[F.col(c).alias(f"{c}_1") for c in others])
        b = right.select(PAIR[1], F.explode(key).alias("at"), *[F.col(c).alias(f"{c}_2") for c in others])
        many = a.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")).where("shares > 1")
        a = a.join(many, "at", "left").withColumn("share", F.pmod(F.xxhash64(PAIR[0]), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
        b = b.join(many, "at", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
        one = (F.size(f"{key}_1") == 1) | (F.size(f"{key}_2") == 1)
        found = a.join(b, ["at", "share"]).where(one | (F.array_min(F.array_intersect(f"{key}_1", f"{key}_2")) == F.col("at")))
        if earlier is not None:
            alone = (F.size(f"{earlier}_1") <= 1) & (F.size(f"{earlier}_2") <= 1)  # two texts are compared far faster than two sets
            same = F.coalesce(F.get(f"{earlier}_1", F.lit(0)) == F.get(f"{earlier}_2", F.lit(0)), F.lit(False))
            found = found.where(~F.when(alone, same).otherwise(F.arrays_overlap(f"{earlier}_1", f"{earlier}_2")))
        return found.select(*PAIR)

    return pairs("name_compact", None).union(pairs("address_compact", "name_compact"))


#: The grid of selective prefixes (name, address, cap).
SELECTIVE = {"p7_a12_f50": (7, 12, 50), "p7_a12_f100": (7, 12, 100), "p6_a10_f50": (6, 10, 50), "p6_a10_f100": (6, 10, 100), "p7_a10_f100": (7, 10, 100)}


def selective_prefix(s1: DataFrame, targets: DataFrame, config: str, existing: DataFrame | None = None, max_candidates: int | None = None) -> DataFrame:
    pairs = prefix_pairs(s1, targets, *SELECTIVE[config])
    if existing is not None:
        pairs = pairs.union(existing.select(*PAIR)).distinct()
    return guard(pairs, max_candidates)

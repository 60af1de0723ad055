"""Pairwise features of candidate pairs, one projection and one Arrow UDF per text field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, scorers
from ..functions.text import present, strip
from ..schema import BLOCKERS, PAIR, LinkageError, SchemaError

RECORD = ("business_name", "business_address", "country", "name_norm", "name_compact", "name_tokens", "address_norm", "address_compact", "address_tokens", "address_numbers")

#: Columns that records may have; where one is missing the country stands for it.
CODES = ("country_norm", "country_code")

#: Names of features that trained models know.
NUMERIC = ("numeric_count_1", "numeric_count_2", "numeric_overlap_count", "numeric_jaccard", "numeric_exact_match", "numeric_any_overlap")
COUNTRY = ("country_exact", "country_norm_exact", "country_code_exact", "country_both_present", "country_missing_1", "country_missing_2")


def enrich(pairs: DataFrame, s1: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs with both records as structs `a` and `b`; `strict` refuses pairs whose record is missing."""

    def record(df: DataFrame) -> Column:
        codes = [present(F.col(c if c in df.columns else "country")).alias(c) for c in CODES]
        return F.struct(*RECORD, *codes)

    left = s1.select(F.col("entity_id").alias(PAIR[0]), record(s1).alias("a"))
    right = targets.select(PAIR[1], "candidate_source", record(targets).alias("b"))
    if strict:
        for side, key in ((left, PAIR[0]), (right, PAIR[1])):
            if lost := pairs.select(key).join(side, key, "left_anti").limit(1).collect():
                raise LinkageError(f"no record of {lost[0][0]}")
    return pairs.join(left, PAIR[0]).join(right, PAIR[1])


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _equal(a: Column, b: Column) -> Column:
    return _flag((a != "") & (a == b))


def _or_else(first: Column, second: Column) -> Column:
    return F.when(present(first) != "", first).otherwise(present(second))


def _lengths(prefix: str, a: Column, b: Column) -> dict[str, Column]:
    return {f"{prefix}_1": F.length(a), f"{prefix}_2": F.length(b), f"{prefix}_diff": F.abs(F.length(a) - F.length(b))}


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+", -1), lambda t: t != ""))


def _field(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def name_features() -> dict[str, Column]:
    a, b = (_or_else(_field(s, "name_norm"), strip(present(_field(s, "business_name")))) for s in "ab")
    ca, cb = (_or_else(_field(s, "name_compact"), F.replace(x, F.lit(" "), F.lit(""))) for s, x in (("a", a), ("b", b)))
    raw = [strip(present(_field(s, "business_name"))) for s in "ab"]
    out = {"name_exact": _equal(*raw), "name_norm_exact": _equal(present(_field("a", "name_norm")), present(_field("b", "name_norm"))), "name_compact_exact": _equal(ca, cb)}
    out |= {f"name_{s}": F.col(f"name_scores.{s}") for s in ("ratio", "partial_ratio", "jaro_winkler", "token_sort_ratio", "token_set_ratio")}
    out["name_token_jaccard"] = arrays.jaccard(_tokens(a), _tokens(b), empty=1.0)
    return out | _lengths("name_length", a, b) | _lengths("name_compact_length", ca, cb)


def address_features() -> dict[str, Column]:
    a, b = (_or_else(_field(s, "address_norm"), strip(present(_field(s, "business_address")))) for s in "ab")
    ca, cb = (_or_else(_field(s, "address_compact"), F.replace(x, F.lit(" "), F.lit(""))) for s, x in (("a", a), ("b", b)))
    raw = [strip(present(_field(s, "business_address"))) for s in "ab"]
    out = {"address_exact": _equal(*raw), "address_norm_exact": _equal(present(_field("a", "address_norm")), present(_field("b", "address_norm"))), "address_compact_exact": _equal(ca, cb)}
    out |= {"address_missing_1": _flag(a == ""), "address_missing_2": _flag(b == ""), "address_both_missing": _flag((a == "") & (b == ""))}
    out |= {f"address_{s}": F.col(f"address_scores.{s}") for s in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")}
    out["address_token_jaccard"] = arrays.jaccard(_tokens(a), _tokens(b))
    return out | _lengths("address_length", a, b) | _lengths("address_compact_length", ca, cb)


def numeric_features() -> dict[str, Column]:
    a, b = (arrays.as_set(_field(s, "address_numbers")) for s in "ab")
    shared = arrays.overlap(a, b)
    same = _flag((F.size(a) > 0) & (F.size(b) > 0) & (shared == F.size(a)) & (shared == F.size(b)))
    return dict(zip(NUMERIC, (F.size(a), F.size(b), shared, arrays.jaccard(a, b), same, _flag(shared > 0)), strict=True))


def country_features() -> dict[str, Column]:
    def folded(side: str, name: str) -> Column:
        return F.replace(F.lower(strip(present(_field(side, name)))), F.lit("ß"), F.lit("ss"))

    a, b = (folded(s, "country") for s in "ab")
    same = [_equal(folded("a", c), folded("b", c)) for c in ("country", *CODES)]
    return dict(zip(COUNTRY, (*same, _flag((a != "") & (b != "")), _flag(a == ""), _flag(b == "")), strict=True))


def lexical_features(field: str, prefix: str, scores: str) -> dict[str, Column]:
    a, b = (present(_field(s, field)) for s in "ab")
    ta, tb = _tokens(a), _tokens(b)
    out = {"exact": _equal(a, b)} | {s: F.col(f"{scores}.{s}") for s in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")}
    out |= {"token_jaccard": arrays.jaccard(ta, tb), "token_count_1": F.size(ta), "token_count_2": F.size(tb), "token_overlap_count": arrays.overlap(ta, tb)}
    return {f"{prefix}_{k}": v for k, v in (out | _lengths("length", a, b)).items()}


def blocker_features() -> dict[str, Column]:
    found = arrays.clean_tokens(F.col("blocker_provenance"))
    ranks = F.coalesce(F.col("ranks"), F.create_map().cast("map<string,int>"))
    valid = F.filter(F.map_values(ranks), lambda r: r >= 1)
    out = {
        "blocker_num_blockers": F.coalesce(F.col("num_blockers"), F.size(found)),
        "blocker_best_rank": F.coalesce(F.array_min(valid), F.lit(0)),
        "blocker_has_rank": _flag(F.size(valid) > 0),
        "blocker_rank_count": F.size(valid),
        "blocker_provenance_count": F.size(found),
    }
    for name in BLOCKERS:
        rank = F.greatest(F.coalesce(F.try_element_at(ranks, F.lit(name)), F.lit(0)), F.lit(0))
        out |= {f"blocker_has_{name}": _flag(F.array_contains(found, name)), f"blocker_{name}_rank": rank, f"blocker_{name}_has_rank": _flag(rank > 0)}
    return out


def source_flags(by_id: bool = False) -> dict[str, Column]:
    """Flags by the tag of the target, or `by_id` by the beginning of its id."""
    of = lambda s: F.col(PAIR[1]).startswith(f"{s}-") if by_id else F.col("candidate_source") == s
    return {f"candidate_is_{s.lower()}": _flag(of(s)) for s in ("S2", "S3")}


#: The double "lexical" is the name that trained models know.
def all_features(blockers: bool = True) -> dict[str, Column]:
    out = name_features() | address_features() | numeric_features() | country_features()
    out |= lexical_features("name_norm", "name_lexical", "name_lexical_scores") | lexical_features("address_norm", "address_lexical_lexical", "address_lexical_scores")
    return out | (blocker_features() if blockers else {}) | source_flags()


def set_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The features that need no fuzzy scorer, all inside the JVM."""
    wanted = {k: v for k, v in all_features(blockers=False).items() if not any(k.endswith(f"_{s}") for s in scorers.SCORERS)}
    return enrich(pairs, s1, targets).select(*PAIR, *[v.alias(k) for k, v in wanted.items()])


def feature_frame(pairs: DataFrame, s1: DataFrame, targets: DataFrame, strict: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """All features of candidate pairs: 70 columns, or 90 where pairs have blocker_provenance, ranks and num_blockers.

    `more` are further columns, of what the pairs have and of both records `a` and `b`.
    """
    blockers = "blocker_provenance" in pairs.columns
    rich = enrich(pairs, s1, targets, strict)
    without = tuple(s for s in scorers.SCORERS if s != "jaro_winkler")  # no feature of addresses
    for prefix, field, raw, names in (("name", "name_norm", "business_name", scorers.SCORERS), ("address", "address_norm", "business_address", without)):
        a, b = (_or_else(_field(s, field), strip(present(_field(s, raw)))) for s in "ab")
        rich = rich.withColumn(f"{prefix}_scores", scorers.score(a, b, names))
        # Where both norms are there, as almost always, the lexical scores are the same ones.
        both = (present(_field("a", field)) != "") & (present(_field("b", field)) != "")
        empty = F.struct(*[F.when((present(_field("a", field)) == "") & (present(_field("b", field)) == "") & F.lit(s != "token_set_ratio"), 1.0).otherwise(0.0).alias(s) for s in names])
        rich = rich.withColumn(f"{prefix}_lexical_scores", F.when(both, F.col(f"{prefix}_scores")).otherwise(empty))
    return rich.select(*PAIR, "candidate_source", *[v.alias(k) for k, v in (all_features(blockers) | (more or {})).items()])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*PAIR, "candidate_source", "source", "label", "match_probability")]


def select_families(df: DataFrame, *, address: bool = True, lexical: bool = True, blocker: bool = True) -> list[str]:
    """Feature columns without the families that are turned off; `address` includes the lexical ones of addresses."""
    out = feature_columns(df)
    if not address:
        out = [c for c in out if not c.startswith("address_")]
    if not lexical:
        out = [c for c in out if "lexical_" not in c]
    return out if blocker else [c for c in out if not c.startswith("blocker_")]


def align(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids, the columns to keep and the features of a model in its order, checked to be numbers without nulls."""
    if missing := [c for c in features if c not in df.columns]:
        raise SchemaError(f"missing features {missing}")
    if odd := [c for c, t in df.select(*features).dtypes if t not in ("int", "bigint", "double", "float", "smallint", "tinyint")]:
        raise SchemaError(f"features that are no numbers {odd}")
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if not df.where(bad).isEmpty():
        raise SchemaError("features with nulls")
    return df.select(*PAIR, *keep, *features)

"""Named queries over a data folder, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers, text
from ..operators import blocking, evaluation, features, nearest, pairs, profile, ranking
from ..operators.model import train
from ..schema import PAIR
from ..sources.scratch import written
from ..sources.writers import list_per_entity
from . import flows
from .fixture import Records, load, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _records(name: str):
    """Register a query over the record fixture."""

    def wrap(f: Callable[[Records], DataFrame]) -> Callable[[Records], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        return f

    return wrap


def _text(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def _rounded(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def listed(united: DataFrame) -> DataFrame:
    """United candidates with provenance and ranks as texts."""
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws(":", e["key"], e["value"])), "|")
    return united.select(*PAIR, "source", _text("blocker_provenance"), ranks.alias("ranks"), "num_blockers", "best_rank")


@_records("normalize_names")
def _(r: Records) -> DataFrame:
    return r.s1.unionByName(r.s2).unionByName(r.s3).select("entity_id", "name_norm", "name_compact", _text("name_tokens"))


@_records("normalize_addresses")
def _(r: Records) -> DataFrame:
    return r.s1.unionByName(r.s2).unionByName(r.s3).select("entity_id", "address_norm", "address_compact", _text("address_tokens"), _text("address_numbers"))


def _normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "full")
    return r.s1.unionByName(r.s2).unionByName(r.s3).select("entity_id", "name_norm", "address_norm")


QUERIES["normalize_full_unicode"] = _normalize_full


@_records("profile_sources")
def _(r: Records) -> DataFrame:
    return profile.profile({"S1": r.s1, "S2": r.s2, "S3": r.s3})


@_records("country_histogram")
def _(r: Records) -> DataFrame:
    return profile.countries(r.raw)


@_records("truth_buckets")
def _(r: Records) -> DataFrame:
    return profile.truth_buckets(r.truth)


@_records("id_differences")
def _(r: Records) -> DataFrame:
    return profile.id_differences(r.s1, r.truth.where("size(matched) > 0"))


for _column in ("name_compact", "address_compact"):
    QUERIES[f"freq_{_column.split('_')[0]}"] = lambda spark, d, c=_column: blocking.key_frequency(load(spark, d).targets, c)
for _column, _name in (("name_tokens", "freq_name_token"), ("address_tokens", "freq_address_token"), ("address_numbers", "freq_number")):
    QUERIES[_name] = lambda spark, d, c=_column: blocking.element_frequency(load(spark, d).targets, c)
    QUERIES[f"block_{_name.removeprefix('freq_')}"] = lambda spark, d, c=_column: blocking.pair_by_rare_element((r := load(spark, d)).s1, r.targets, c, 100)


@_records("block_exact_pair")
def _(r: Records) -> DataFrame:
    return blocking.pair_by_keys(r.s1, r.targets, ["name_compact", "address_compact"])


@_records("block_rare_name")
def _(r: Records) -> DataFrame:
    return blocking.pair_by_rare_key(r.s1, r.targets, "name_compact", 100)


@_records("block_rare_address")
def _(r: Records) -> DataFrame:
    return blocking.pair_by_rare_key(r.s1, r.targets, "address_compact", 100)


@_records("block_three_rule")
def _(r: Records) -> DataFrame:
    return blocking.three_rules(r.s1, r.targets)


@_records("block_six_rule")
def _(r: Records) -> DataFrame:
    return blocking.six_rules(r.s1, r.targets)


def _evidence(df: DataFrame) -> DataFrame:
    return df.select(*PAIR, "source", "blocker", _text("evidence"), "rank")


@_records("exact_blocker")
def _(r: Records) -> DataFrame:
    return _evidence(blocking.exact_blocker(r.s1, r.targets))


@_records("rare_token_blocker")
def _(r: Records) -> DataFrame:
    return _evidence(blocking.rare_token_blocker(r.s1, r.targets))


@_records("numeric_blocker")
def _(r: Records) -> DataFrame:
    return _evidence(blocking.numeric_blocker(r.s1, r.targets))


@_records("tfidf_blocker")
def _(r: Records) -> DataFrame:
    return nearest.tfidf_blocker(r.s1, r.targets, top_k=5).select(*PAIR, "source", "rank", _rounded("score", "similarity"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.dense_blocker(*vectors(spark, sf_dir), top_k=5).select(*PAIR, "source", "rank", _rounded("score", "similarity"))


QUERIES["dense_knn"] = _dense


@_records("dense_text")
def _(r: Records) -> DataFrame:
    found = nearest.dense_blocker(r.s1, r.targets, top_k=5, embed=nearest.hashed_embedding())
    return found.select(*PAIR, "source", "blocker", "rank", _rounded("score", "score"))


@_records("generator")
def _(r: Records) -> DataFrame:
    return listed(flows.generate(r.s1, r.targets, use_dense=True, top_k=10, embed=nearest.hashed_embedding()))


def _united(r: Records) -> DataFrame:
    return blocking.candidate_union(blocking.exact_blocker(r.s1, r.targets), blocking.rare_token_blocker(r.s1, r.targets), blocking.numeric_blocker(r.s1, r.targets))


@_records("candidate_union")
def _(r: Records) -> DataFrame:
    return listed(_united(r))


@_records("prefix_block")
def _(r: Records) -> DataFrame:
    return blocking.prefix_pairs(r.s1, r.targets)


for _config in blocking.SELECTIVE:
    QUERIES[f"selective_prefix_{_config}"] = lambda spark, d, c=_config: blocking.selective_prefix((r := load(spark, d)).s1, r.targets, c)


@_records("rule_matches")
def _(r: Records) -> DataFrame:
    return flows.rule_flow(r.s1, r.targets).matches


@_records("candidate_lists")
def _(r: Records) -> DataFrame:
    return list_per_entity(r.s1, blocking.three_rules(r.s1, r.targets), "candidate_entity_ids")


@_records("match_lists")
def _(r: Records) -> DataFrame:
    return list_per_entity(r.s1, flows.rule_flow(r.s1, r.targets).matches, "matched_entity_ids")


@_records("zero_candidates")
def _(r: Records) -> DataFrame:
    return evaluation.zero_candidates(r.s1, blocking.three_rules(r.s1, r.targets))


@_records("candidate_stats_linear")
def _(r: Records) -> DataFrame:
    s = evaluation.linear_stats(evaluation.candidate_counts(r.s1, blocking.six_rules(r.s1, r.targets)))
    return s.select(_rounded("mean", "mean"), _rounded("median", "median"), _rounded("p95", "p95"), "max", "zeros")


@_records("candidate_stats_index")
def _(r: Records) -> DataFrame:
    s = evaluation.index_stats(evaluation.candidate_counts(r.s1, blocking.six_rules(r.s1, r.targets)).where("n > 0"))
    return s.select(_rounded("mean", "mean"), _rounded("median", "median"), "p95", "max")


SET_COLUMNS = ("name_token_jaccard", "address_token_jaccard", *features.NUMERIC, *features.COUNTRY, "name_lexical_token_count_1", "name_lexical_token_count_2", "name_lexical_token_overlap_count", "address_lexical_lexical_token_jaccard", "candidate_is_s2", "candidate_is_s3")
EXACT_COLUMNS = tuple(f"{f}_{c}" for f in ("name", "address") for c in ("exact", "norm_exact", "compact_exact", "length_1", "length_2", "length_diff", "compact_length_1", "compact_length_2", "compact_length_diff")) + ("address_missing_1", "address_missing_2", "address_both_missing")


@_records("features_set")
def _(r: Records) -> DataFrame:
    out = features.set_features(blocking.six_rules(r.s1, r.targets), r.s1, r.targets)
    return out.select(*PAIR, *[_rounded(c, c) if "jaccard" in c else c for c in SET_COLUMNS])


@_records("features_exact_length")
def _(r: Records) -> DataFrame:
    return features.set_features(blocking.six_rules(r.s1, r.targets), r.s1, r.targets).select(*PAIR, *EXACT_COLUMNS)


@_records("features_blocker")
def _(r: Records) -> DataFrame:
    columns = features.blocker_features()
    return _united(r).select(*PAIR, *[v.alias(k) for k, v in columns.items()])


@_records("features_full")
def _(r: Records) -> DataFrame:
    frame = features.feature_frame(_united(r), r.s1, r.targets)
    return frame.select(*[_rounded(c, c) if t == "double" else c for c, t in frame.dtypes])


@_records("jaro_winkler")
def _(r: Records) -> DataFrame:
    rich = features.enrich(blocking.six_rules(r.s1, r.targets), r.s1, r.targets)
    a, b = (F.regexp_replace(f"{x}.name_norm", r"[^\x00-\x7F]", "?") for x in "ab")  # the SQL function compares bytes
    return rich.select(*PAIR, _rounded(scorers.score(a, b, ("jaro_winkler",))["jaro_winkler"], "jaro_winkler"))


@_records("indel_ratio")
def _(r: Records) -> DataFrame:
    rich = features.enrich(blocking.three_rules(r.s1, r.targets), r.s1, r.targets)
    return rich.select(*PAIR, _rounded(scorers.score(F.col("a.address_norm"), F.col("b.address_norm"), ("ratio",))["ratio"], "ratio"))


def _scored(r: Records) -> DataFrame:
    return ranking.score_pairs(blocking.six_rules(r.s1, r.targets), r.s1, r.targets, ranking.jaccard_score())


@_records("heuristic_sql_jaccard")
def _(r: Records) -> DataFrame:
    return _scored(r).select(*PAIR, _rounded("score", "score"))


@_records("heuristic_sql_boolean")
def _(r: Records) -> DataFrame:
    return ranking.score_pairs(blocking.six_rules(r.s1, r.targets), r.s1, r.targets, ranking.boolean_score())


def _weighted(weights: dict[str, float]) -> Callable[[Records], DataFrame]:
    def run(r: Records) -> DataFrame:
        frame = features.set_features(blocking.six_rules(r.s1, r.targets), r.s1, r.targets)
        return frame.select(*PAIR, _rounded(ranking.weighted_score(weights), "score"))

    return run


_records("heuristic_feature_light")(_weighted(ranking.LIGHT))
_records("heuristic_feature_heavy")(_weighted(ranking.HEAVY))


def _stable(r: Records) -> DataFrame:
    return _scored(r).withColumn("score", F.round("score", 6))


for _k in (10, 20, 30):
    QUERIES[f"topk_{_k}"] = lambda spark, d, k=_k: ranking.top_k(_stable(load(spark, d)), k)


@_records("topk_sweep")
def _(r: Records) -> DataFrame:
    out = ranking.sweep(_stable(r), evaluation.truth_pairs(r.truth), r.s1, (5, 10, 20, 50))
    return out.select("k", "n_pairs", *[_rounded(c, c) for c in ("link_recall", "complete_recall", "mean", "p95")], "zeros")


@_records("prefix_comparison")
def _(r: Records) -> DataFrame:
    """Counted by groups of equal values: the pairs themselves grow with the square of a group."""
    out = flows.prefix_comparison(r.s1, r.targets, r.groups)
    return out.select("name", "n_pairs", *[_rounded(c, c) for c in ("link_recall", "complete_recall", "mean", "p95")], "zeros")


@_records("union_report")
def _(r: Records) -> DataFrame:
    out = evaluation.union_report(r.truth, _united(r))
    return out.select(*[_rounded(c, c) for c in ("link_recall", "complete_recall", "mean", "median")], "p95", "max")


@_records("batch_ids")
def _(r: Records) -> DataFrame:
    return pairs.batches(r.s1, 50)


@_records("link_recall")
def _(r: Records) -> DataFrame:
    return evaluation.recalls(r.truth, blocking.six_rules(r.s1, r.targets)).select(_rounded("link_recall", "link_recall"))


@_records("complete_recall")
def _(r: Records) -> DataFrame:
    return evaluation.recalls(r.truth, blocking.six_rules(r.s1, r.targets)).select(_rounded("complete_recall", "complete_recall"))


@_records("per_entity_recall")
def _(r: Records) -> DataFrame:
    out = evaluation.per_entity_recall(r.truth, blocking.three_rules(r.s1, r.targets))
    return out.select(PAIR[0], "n_true", "n_found", _rounded("recall", "recall"))


@_records("entity_f05")
def _(r: Records) -> DataFrame:
    out = evaluation.entity_f05(r.truth, flows.rule_flow(r.s1, r.targets).matches)
    return out.select(PAIR[0], "tp", "fp", "fn", *[_rounded(c, c) for c in ("precision", "recall", "f05")])


@_records("macro_f05")
def _(r: Records) -> DataFrame:
    return evaluation.macro_f05(r.truth, flows.rule_flow(r.s1, r.targets).matches).select(_rounded("macro_f05", "macro_f05"))


#: Fixed value: the highest score the heuristic can give, so that scores divided by it lie in [0, 1].
TOP_SCORE = 2210.0


@_records("threshold_search")
def _(r: Records) -> DataFrame:
    scored = _stable(r).withColumn("score", F.round(F.col("score") / TOP_SCORE, 6))
    return evaluation.threshold_table(r.truth, scored).select("threshold", _rounded("macro_f05", "macro_f05"))


@_records("labels")
def _(r: Records) -> DataFrame:
    return pairs.label(blocking.three_rules(r.s1, r.targets), r.truth)


@_records("positive_pairs")
def _(r: Records) -> DataFrame:
    return pairs.positives(r.truth)


@_records("hard_negatives")
def _(r: Records) -> DataFrame:
    frame = features.set_features(blocking.six_rules(r.s1, r.targets), r.s1, r.targets)
    out = pairs.hard_negatives(frame, r.truth, features=("numeric_jaccard", "country_exact", "name_token_jaccard"))
    return out.select(*PAIR, "label", _rounded("hard_negative_score", "hard_negative_score"))


@_records("negative_sampling")
def _(r: Records) -> DataFrame:
    return pairs.negatives(blocking.six_rules(r.s1, r.targets), r.truth, 2)


@_records("three_way_split")
def _(r: Records) -> DataFrame:
    parts = pairs.three_way(r.s1.select("entity_id"))
    return parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("tune"))).unionByName(parts[2].withColumn("part", F.lit("evaluate")))


@_records("group_kfold")
def _(r: Records) -> DataFrame:
    return pairs.fold_of(blocking.six_rules(r.s1, r.targets), 5)


@_records("sample_s1")
def _(r: Records) -> DataFrame:
    return pairs.sample_entities(r.s1.select("entity_id"), 50)


@_records("distractors")
def _(r: Records) -> DataFrame:
    needed = evaluation.truth_pairs(r.truth).select(F.col(PAIR[1]).alias("entity_id")).where("entity_id like 'S2-%'")
    return pairs.with_distractors(r.s2.select("entity_id"), needed, 20)


@_records("integrity_check")
def _(r: Records) -> DataFrame:
    flow = flows.rule_flow(r.s1, r.targets)
    return evaluation.integrity(r.s1, flow.candidates, flow.matches, list_per_entity(r.s1, flow.matches, "matched_entity_ids"))


@_records("extract_numbers")
def _(r: Records) -> DataFrame:
    return r.raw.select("entity_id", F.array_join(text.numbers(F.col("business_address")), "|").alias("numbers"))


#: Small trees, so that the query ends in seconds; the defaults are those of the matcher.
SMALL = {"maxIter": 10, "maxDepth": 4}


def _training(r: Records) -> tuple[DataFrame, list[str]]:
    frame = written(pairs.label(features.feature_frame(_united(r), r.s1, r.targets), r.truth), "training")  # read by every check and tree
    return frame, features.feature_columns(frame)


@_records("train_and_score")
def _(r: Records) -> DataFrame:
    frame, columns = _training(r)
    return train(frame, columns, **SMALL).matcher.score(frame)


@_records("feature_importance")
def _(r: Records) -> DataFrame:
    frame, columns = _training(r)
    return train(frame, columns, **SMALL).matcher.importance(r.s1.sparkSession)


@_records("full_pipeline")
def _(r: Records) -> DataFrame:
    """The matcher's own trees and cut (`model.DEFAULTS`, the k of `train_and_match`), not those of a smaller model."""
    pool = blocking.six_rules(r.s1, r.targets)
    _, matches = flows.train_and_match(pool, r.s1, r.targets, r.groups)
    return list_per_entity(r.s1, matches, "matched_entity_ids")

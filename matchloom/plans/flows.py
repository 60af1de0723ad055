"""End-to-end flows: rules alone, the library pipeline, training, and inference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, blocking, evaluation, features, model, nearest, pairs, ranking
from ..schema import PAIR, LinkageError
from ..sources import writers
from ..sources.scratch import written


@dataclass
class RuleFlow:
    candidates: DataFrame
    matches: DataFrame


def rule_flow(s1: DataFrame, targets: DataFrame, cap: int = 20, match_cap: int = 3) -> RuleFlow:
    """Three-rule candidates and model-free matches."""
    candidates = blocking.three_rules(s1, targets, cap)
    return RuleFlow(candidates, blocking.rule_matches(s1, targets, candidates, match_cap))


def generate(s1: DataFrame, targets: DataFrame, *, use_dense: bool = False, top_k: int = 50, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """United candidates of all blockers; `use_dense` needs an `embedding` column on both sides, or `embed`."""
    if targets.isEmpty():
        raise LinkageError("no targets")
    blocked = [blocking.exact_blocker(s1, targets), blocking.rare_token_blocker(s1, targets), blocking.numeric_blocker(s1, targets), nearest.tfidf_blocker(s1, targets, top_k=top_k)]
    if use_dense:
        blocked.append(nearest.dense_blocker(s1, targets, top_k, embed=embed))
    return blocking.candidate_union(*blocked)


def prefix_comparison(s1: DataFrame, targets: DataFrame, truth: evaluation.Groups) -> DataFrame:
    """name and the report of the three rules, of plain prefixes, and of both; no pairs are made."""
    counts = agreement.prefix_counts(s1, targets, truth, {"plain": (5, 8, None)})
    return evaluation.summary(counts.withColumnRenamed("table", "k")).withColumnRenamed("k", "name")


def selective_report(s1: DataFrame, targets: DataFrame, truth: evaluation.Truth, existing: DataFrame | None, max_candidates: int | None = 2_000_000) -> DataFrame:
    """name, n_prefix and the report of every configuration of selective prefixes united with the existing candidates.

    A configuration of more than `max_candidates` prefix pairs is not evaluated: its row has nulls behind n_prefix. None
    sets no limit. With a truth by groups the existing candidates are those of the three rules (None), and no pairs are made.
    """
    if isinstance(truth, evaluation.Groups):
        if existing is not None:
            raise LinkageError("a truth by groups is counted with the three rules only")
        return _selective_counts(s1, targets, truth, max_candidates)
    if existing is None:
        existing = blocking.three_rules(s1, targets)
    known, blocked, sizes = written(existing.select(*PAIR).distinct(), "existing"), {}, []
    for name in blocking.SELECTIVE:
        found = written(blocking.selective_prefix(s1, targets, name), "prefix-pairs")
        sizes.append((name, found.count()))
        if max_candidates is None or sizes[-1][1] <= max_candidates:
            blocked[name] = found.unionByName(known)
    counts = s1.sparkSession.createDataFrame(sizes, "name string, n_prefix long")
    if not blocked:
        raise LinkageError("every configuration exceeds the limit")
    return counts.join(evaluation.compare(blocked, evaluation.truth_pairs(truth), s1), "name", "left")


def _selective_counts(s1: DataFrame, targets: DataFrame, truth: evaluation.Groups, max_candidates: int | None) -> DataFrame:
    counts = written(agreement.prefix_counts(s1, targets, truth, blocking.SELECTIVE).where("table <> 'existing'"), "counts")
    sizes = counts.where("table = 'prefix'").groupBy(F.col("config").alias("name")).agg(F.sum("n").alias("n_prefix"))
    within = sizes if max_candidates is None else sizes.where(F.col("n_prefix") <= max_candidates)
    if max_candidates is not None and within.isEmpty():
        raise LinkageError("every configuration exceeds the limit")
    report = evaluation.summary(counts.where("table = 'combined'").withColumnRenamed("config", "k")).withColumnRenamed("k", "name")
    return sizes.join(report.join(within.select("name"), "name", "left_semi"), "name", "left")


@dataclass
class Trained:
    """`macro_f05` is that of the entities that chose the threshold, `held_out_f05` that of entities that nothing has seen."""

    matcher: model.Matcher
    threshold: float
    macro_f05: float
    held_out_f05: float
    training: model.Training
    importance: DataFrame


@dataclass
class Judged:
    threshold: float
    tune_f05: float
    held_out_f05: float


def judge(tune: evaluation.Truth, held: evaluation.Truth, scored: DataFrame, score: str) -> Judged:
    """The threshold that is best for the entities of `tune`, and its macro F0.5 there and on those of `held`.

    Both are truth tables with all their entities: one without candidates has an empty prediction.
    """
    best = evaluation.best_threshold(tune, scored, score).first()
    found = evaluation.select_matches(scored, best["threshold"], score)
    return Judged(best["threshold"], best["macro_f05"], evaluation.macro_f05(held, found).first()[0])


def three_truths(truth: evaluation.Truth, seed: int = 42) -> list[evaluation.Truth]:
    """The truth of the entities to train on, to tune and to evaluate with."""
    if isinstance(truth, evaluation.Groups):
        return [evaluation.Groups(part, truth.members) for part in pairs.split_groups(truth.entities, (0.7, 0.15, 0.15), PAIR[0], seed)]
    return pairs.split_groups(truth, (0.7, 0.15, 0.15), PAIR[0], seed)


def _train(candidates: DataFrame, s1: DataFrame, targets: DataFrame, truth: evaluation.Truth, use_blockers: bool, every: bool, params: dict) -> tuple[Trained, DataFrame]:
    """What was trained, and the scores (match_probability and heuristic) of all pairs, or of those not trained on.

    Label and part join the ids before the records do, so that rows of features are written once and never shuffled.
    """
    parts = three_truths(truth)
    entities = [(part.entities if isinstance(part, evaluation.Groups) else part).select(PAIR[0]).distinct() for part in parts]
    numbered = reduce(DataFrame.unionByName, [ids.withColumn("part", F.lit(i)) for i, ids in enumerate(entities)])
    known = pairs.label(candidates, truth).join(numbered, PAIR[0], "left")
    more = {"label": F.col("label"), "part": F.coalesce("part", F.lit(-1)), "heuristic": ranking.jaccard_score()}
    frame = written(features.feature_frame(known, s1, targets, more=more), "training")
    columns = features.select_families(frame.drop("part", "heuristic"), blocker=use_blockers)
    trained = model.train(frame.where("part = 0"), columns, frame.where("part = 1"), **params)
    scored = written(trained.matcher.score(frame if every else frame.where("part <> 0"), ("part", "heuristic")), "scores")
    judged = judge(*parts[1:], scored.where("part <> 0"), "match_probability")
    return Trained(trained.matcher, judged.threshold, judged.tune_f05, judged.held_out_f05, trained, trained.matcher.importance(s1.sparkSession)), scored


def train_flow(candidates: DataFrame, s1: DataFrame, targets: DataFrame, truth: evaluation.Truth, *, use_blockers: bool = True, **params) -> Trained:
    """Features and labels, entities of the truth split in three, training, threshold on the second and score on the third."""
    return _train(candidates, s1, targets, truth, use_blockers, False, params)[0]


def train_and_match(candidates: DataFrame, s1: DataFrame, targets: DataFrame, truth: evaluation.Truth, *, k: int = 30, use_blockers: bool = True, **params) -> tuple[Trained, DataFrame]:
    """`train_flow`, and the matches among the k best candidates of each entity, from the features made for training."""
    trained, scored = _train(candidates, s1, targets, truth, use_blockers, True, params)
    return trained, evaluation.select_matches(ranking.top_k(scored, k, "heuristic"), trained.threshold, "match_probability")


def infer_flow(s1: DataFrame, targets: DataFrame, matcher: model.Matcher, threshold: float, *, k: int = 30, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Six-rule candidates cut to the k best by score, and the matches the model selects: ids until the cut, records after."""
    candidates = blocking.six_rules(s1, targets, cap)
    best = ranking.top_k(ranking.score_pairs(candidates, s1, targets, ranking.jaccard_score()), k).select(*PAIR)
    scored = matcher.score(features.feature_frame(best, s1, targets))
    return candidates, evaluation.select_matches(scored, threshold, "match_probability")


def submit(s1: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str) -> DataFrame:
    """Write both lists and return the integrity report."""
    candidates, matches = (written(df.select(*PAIR), "pairs") for df in (candidates, matches))
    lists = writers.write_both_outputs(s1, candidates, matches, folder)
    return evaluation.integrity(s1, candidates, matches, lists.select(PAIR[0]))

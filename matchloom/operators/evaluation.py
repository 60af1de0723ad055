"""Blocking recall, entity F0.5, threshold search and integrity checks, as joins of pair tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAIR, LinkageError

BETA2 = 0.25


@dataclass
class Groups:
    """A truth by groups: an entity matches all members of its groups, whose pairs grow with the square of a group's size.

    `entities` (source1_entity_id, group) holds all entities, those without matches too, by a group without members or
    null; `members` are (group, candidate_entity_id).
    """

    entities: DataFrame
    members: DataFrame


Truth = DataFrame | Groups


def _of(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.collect_set("group").alias(name))


def marked(pairs: DataFrame, truth: Truth, name: str) -> DataFrame:
    """Pairs with 1 in the column `name` where the truth has them, else null; of groups no pair is made."""
    if not isinstance(truth, Groups):
        return pairs.join(truth_pairs(truth).withColumn(name, F.lit(1)), list(PAIR), "left")
    both = pairs.join(_of(truth.members, PAIR[1], "of_2"), PAIR[1], "left").join(_of(truth.entities, PAIR[0], "of_1"), PAIR[0], "left")
    return both.select(*[F.col(c) for c in pairs.columns], F.when(F.arrays_overlap("of_1", "of_2"), 1).alias(name))


def truth_sizes(truth: Truth) -> DataFrame:
    """source1_entity_id, n_true of every entity."""
    if not isinstance(truth, Groups):
        return truth.select(PAIR[0], F.size(F.array_distinct("matched")).alias("n_true"))
    sizes = truth.members.groupBy("group").agg(F.countDistinct(PAIR[1]).alias("size"))
    own = _of(truth.entities, PAIR[0], "groups")
    one = own.where("size(groups) <= 1").select(PAIR[0], F.get("groups", F.lit(0)).alias("group")).join(sizes, "group", "left").select(PAIR[0], F.coalesce("size", F.lit(0)).alias("n_true"))
    # Groups of an id that stands in several rows may share members.
    more = own.where("size(groups) > 1").select(PAIR[0], F.explode("groups").alias("group")).join(truth.members, "group", "left").groupBy(PAIR[0]).agg(F.countDistinct(PAIR[1]).alias("n_true"))
    return one.unionByName(more)


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct pairs of a truth table (source1_entity_id, matched array)."""
    return truth.select(PAIR[0], F.explode("matched").alias(PAIR[1])).distinct()


def per_entity_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """source1_entity_id, n_true, n_found, recall (null without matches) of every entity of the truth."""
    found = truth_pairs(truth).join(candidates.select(*PAIR).distinct().withColumn("hit", F.lit(1)), list(PAIR), "left")
    counts = found.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    rows = truth.select(PAIR[0]).distinct().join(counts, PAIR[0], "left").na.fill(0, ["n_true", "n_found"])
    return rows.withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")))


def recalls(truth: DataFrame, candidates: DataFrame, strict: bool = True) -> DataFrame:
    """One row: link_recall and complete_recall; without any match LinkageError, or 0.0 if not `strict`."""
    rows = per_entity_recall(truth, candidates).where("n_true > 0")
    out = rows.agg((F.sum("n_found") / F.sum("n_true")).alias("link_recall"), F.avg((F.col("n_found") == F.col("n_true")).cast("double")).alias("complete_recall"))
    if strict and rows.isEmpty():
        raise LinkageError("no positive links")
    return out if strict else out.na.fill(0.0)


def candidate_counts(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """source1_entity_id, n of every entity, zero for those without candidates."""
    n = candidates.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
    return entities.select(F.col("entity_id").alias(PAIR[0])).distinct().join(n, PAIR[0], "left").na.fill(0, ["n"])


def linear_stats(counts: DataFrame) -> DataFrame:
    """Mean, median, interpolated 95th percentile, maximum and number of zeros."""
    p95 = F.percentile("n", F.lit(0.95))
    return counts.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), p95.alias("p95"), F.max("n").alias("max"), F.sum((F.col("n") == 0).cast("long")).alias("zeros"))


def index_stats(counts: DataFrame) -> DataFrame:
    """The same, with the value at index int(0.95 n) of the sorted counts as 95th percentile.

    Counts are aggregated by value first, so nothing collects a row per entity.
    """
    by_value = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    total = by_value.agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("n")).alias("sum"), F.max("n").alias("max"))
    upto = by_value.withColumn("upto", F.sum("c").over(Window.orderBy("n")))  # one row per distinct count
    joined = upto.crossJoin(F.broadcast(total))  # one row

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("n")))

    middle = [at(F.floor((F.col("total") - 1) / 2)), at(F.floor(F.col("total") / 2))]
    return joined.agg((F.first("sum") / F.first("total")).alias("mean"), ((middle[0] + middle[1]) / 2).alias("median"), at(F.least(F.floor(F.lit(0.95) * F.col("total")), F.col("total") - 1)).alias("p95"), F.first("max").alias("max"))


def recall_report(cut: DataFrame, truth: DataFrame, entities: DataFrame, ks: list[Column]) -> DataFrame:
    """One row per k over `cut` (k, pair): n_pairs, link_recall, complete_recall, mean, p95, zeros. `truth` are pairs."""
    grid = entities.select(F.col("entity_id").alias(PAIR[0])).distinct().withColumn("k", F.explode(F.array(*ks)))
    n = cut.groupBy("k", PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
    t = truth.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true"))
    hit = cut.select("k", *PAIR).join(truth, list(PAIR)).groupBy("k", PAIR[0]).agg(F.count(F.lit(1)).alias("n_found"))
    return summary(grid.join(n, ["k", PAIR[0]], "left").join(t, PAIR[0], "left").join(hit, ["k", PAIR[0]], "left").na.fill(0))


def summary(rows: DataFrame) -> DataFrame:
    """The report of each k over rows (k, n, n_true, n_found), one for every entity."""
    complete = F.avg(F.when(F.col("n_true") > 0, (F.col("n_found") == F.col("n_true")).cast("double")))
    return rows.groupBy("k").agg(F.sum("n").alias("n_pairs"), (F.sum("n_found") / F.sum("n_true")).alias("link_recall"), complete.alias("complete_recall"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.95)).alias("p95"), F.sum((F.col("n") == 0).cast("long")).alias("zeros"))


def compare(blocked: dict[str, DataFrame], truth: DataFrame, entities: DataFrame) -> DataFrame:
    """The report of each named candidate table (name, pairs, recalls, counts), in one plan. `truth` are pairs."""
    cut = None
    for name, candidates in blocked.items():
        tagged = candidates.select(*PAIR).distinct().withColumn("k", F.lit(name))
        cut = tagged if cut is None else cut.unionByName(tagged)
    return recall_report(cut, truth, entities, [F.lit(name) for name in blocked]).withColumnRenamed("k", "name")


def union_report(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: both recalls and the counts per entity that has candidates."""
    counts = candidates.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
    return recalls(truth, candidates).crossJoin(index_stats(counts))  # one row each


def _f05(tp: Column, predicted: Column, true: Column) -> tuple[Column, Column, Column]:
    precision = F.when(predicted > 0, tp / predicted).otherwise(0.0)
    recall = F.when(true > 0, tp / true).otherwise(0.0)
    score = F.when(precision + recall > 0, (1 + BETA2) * precision * recall / (BETA2 * precision + recall)).otherwise(0.0)
    alone = F.when(predicted == 0, 1.0).otherwise(0.0)  # an entity without matches wants an empty prediction
    return tuple(F.when(true == 0, alone).otherwise(x) for x in (precision, recall, score))


def entity_f05(truth: Truth, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f05 of every entity of the truth; `predicted` are pairs."""
    mine = predicted.select(*PAIR).distinct()
    if isinstance(truth, Groups):
        counts = marked(mine, truth, "t").groupBy(PAIR[0]).agg(F.count("t").alias("tp"), F.count(F.lit(1)).alias("n_predicted"))
        rows = truth_sizes(truth).join(counts, PAIR[0], "left").na.fill(0)
    else:
        both = truth_pairs(truth).withColumn("t", F.lit(1)).join(mine.withColumn("p", F.lit(1)), list(PAIR), "full")
        counts = both.groupBy(PAIR[0]).agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_predicted"), F.count("t").alias("n_true"))
        rows = truth.select(PAIR[0]).distinct().join(counts, PAIR[0], "left").na.fill(0)
    precision, recall, f05 = _f05(F.col("tp"), F.col("n_predicted"), F.col("n_true"))
    return rows.select(PAIR[0], "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), f05.alias("f05"))


def macro_f05(truth: Truth, predicted: DataFrame, predicted_entities: DataFrame | None = None) -> DataFrame:
    """Mean F0.5 over all entities. With `predicted_entities` (ids that were predicted for), these must be the truth's."""
    if predicted_entities is not None:
        known = truth.entities if isinstance(truth, Groups) else truth
        a, b = known.select(PAIR[0]).distinct(), predicted_entities.select(PAIR[0]).distinct()
        for what, rows in (("missing", a.join(b, PAIR[0], "left_anti")), ("extra", b.join(a, PAIR[0], "left_anti"))):
            if first := [r[0] for r in rows.orderBy(PAIR[0]).limit(10).collect()]:
                raise LinkageError(f"{what} entities, first ones {first}")
    return entity_f05(truth, predicted).agg(F.avg("f05").alias("macro_f05"))


def select_matches(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    if not 0 <= threshold <= 1:
        raise LinkageError("threshold outside [0, 1]")
    return scored.where(F.col(score) >= threshold)


def threshold_table(truth: Truth, scored: DataFrame, score: str = "score", grid: list[float] | None = None) -> DataFrame:
    """macro_f05 of every threshold, in one pass over pairs.

    Every pair falls into the last grid step that still selects it. As the threshold falls, an entity's F0.5 changes at
    the steps of its own pairs alone, so only these changes are summed by step, and the sums cumulated over the grid: the
    work is pairs plus entities, not entities times steps.
    """
    grid = [i / 100 for i in range(101)] if grid is None else sorted(grid)
    if not grid:
        raise LinkageError("empty grid")
    steps = F.array(*[F.lit(t) for t in grid])
    bits = F.array(*[F.lit(1 << i) for i in reversed(range(len(grid).bit_length()))])
    # How many steps a score reaches, by a binary search.
    step = F.aggregate(bits, F.lit(0), lambda at, bit: F.when(F.coalesce(F.get(steps, at + bit - 1) <= F.col("s"), F.lit(False)), at + bit).otherwise(at))
    flagged = marked(scored.select(*PAIR, F.col(score).alias("s")), truth, "t")
    counts = flagged.withColumn("step", step).groupBy(PAIR[0], "step").agg(F.count(F.lit(1)).alias("predicted"), F.count("t").alias("tp"))
    true = truth_sizes(truth)
    down = Window.partitionBy(PAIR[0]).orderBy(F.desc("step"))
    reached = counts.join(true, PAIR[0]).select(PAIR[0], "step", "n_true", F.sum("tp").over(down).alias("tp"), F.sum("predicted").over(down).alias("predicted"))
    scores = reached.select(PAIR[0], "step", "n_true", _f05(F.col("tp"), F.col("predicted"), F.col("n_true"))[2].alias("f05"))
    start = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)  # above all pairs nothing is predicted
    # Pairs below all steps come last and are left out here: filtered before, their step would be computed inside the score.
    changes = scores.select("step", (F.col("f05") - F.coalesce(F.lag("f05").over(down), start)).alias("change")).where("step > 0").groupBy("step").agg(F.sum("change").alias("change"))
    whole = true.agg(F.sum(start).alias("start"), F.count(F.lit(1)).alias("n"))
    rows = whole.select("start", "n", F.posexplode(steps).alias("i", "threshold")).withColumn("step", F.col("i") + 1).join(F.broadcast(changes), "step", "left")  # a row a step
    upto = F.sum(F.coalesce("change", F.lit(0.0))).over(Window.orderBy(F.desc("step")))
    return rows.select("threshold", ((F.col("start") + upto) / F.col("n")).alias("macro_f05"))


def best_threshold(truth: Truth, scored: DataFrame, score: str = "score", grid: list[float] | None = None) -> DataFrame:
    """The threshold of the highest macro F0.5, the least among equals (up to rounding noise)."""
    return threshold_table(truth, scored, score, grid).orderBy(F.round("macro_f05", 12).desc(), "threshold").limit(1)


def integrity(entities: DataFrame, candidates: DataFrame, matches: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: matches outside the candidates, entities without a list, entities with several."""
    outside = matches.select(*PAIR).distinct().join(candidates.select(*PAIR), list(PAIR), "left_anti").agg(F.count(F.lit(1)).alias("matches_outside"))
    ids = entities.select(F.col("entity_id").alias(PAIR[0]))
    lost = ids.join(lists, PAIR[0], "left_anti").agg(F.count(F.lit(1)).alias("entities_without_list"))
    twice = lists.groupBy(PAIR[0]).count().where("count > 1").agg(F.count(F.lit(1)).alias("entities_listed_twice"))
    return outside.crossJoin(lost).crossJoin(twice)  # one row each


def zero_candidates(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias(PAIR[0])).join(candidates, PAIR[0], "left_anti")

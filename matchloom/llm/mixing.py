"""Operator 10, mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that hold them (their pattern). A flow network then routes words from
patterns, each with one arc per repetition and a cost that grows with it, over the sources of a pattern to the sources'
targets. The network has one node per pattern and source, whatever the number of documents; a check keeps it within
`MAX_PATTERNS`. From a pattern's flow follow its whole repetitions and the share of words that is taken once more. Which
documents these are, a seeded hash says: words per hash bucket find the bucket in which the share ends, and an exact
running sum inside this one bucket finds the last document.

`copies` gives a document's memberships by its text: every source that holds the same text. The query leaves them out, as
its `source` column names the one source of each row.

Cases: a null source is a source of its own and comes last; a null or empty text has size 0 and takes 0 words; rows of one
doc_id and unlike texts are decided one by one, and so are rows without doc_id, whose place their text's hash gives; rows
with equal doc_id and text are decided together; an empty table gives no rows; a very long text is one document, so the
mix ends within half of it; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

SEED = 20
MAX_REPEATS = 3
MAX_PATTERNS = 100_000


def targets(sizes: dict[Any, int], order: list[Any], weights: tuple[float, ...] = (1, 2, 3), most: int = MAX_REPEATS) -> dict[Any, float]:
    """Words wanted of each source: shares by weight of all words, at most `most` times a source's own; what exceeds that is shared again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    fixed: dict[Any, float] = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        wanted = {s: rest * weight[s] / share for s in free} if share else {}
        above = [s for s in free if wanted[s] > most * sizes[s]]
        if not above:
            return {s: fixed[s] if s in fixed else wanted[s] for s in order}
        fixed |= {s: float(most * sizes[s]) for s in above}


def flow(capacity: dict[tuple, int], wanted: dict[Any, float], most: int = MAX_REPEATS) -> dict[tuple, dict[Any, float]]:
    """Words that each pattern sends to each of its sources: as many as possible, at the least cost.

    The r-th repetition of a pattern costs r * r a word, so repetitions spread before they deepen. Successive shortest
    paths with potentials; each path fills an arc.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(wanted, key=repr)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    head: list[int] = []
    room: list[float] = []
    cost: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, most_words: float, price: float) -> int:
        for start, end, words, c in ((a, b, most_words, price), (b, a, 0.0, -price)):
            out[start].append(len(head))
            head.append(end)
            room.append(words)
            cost.append(c)
        return len(head) - 2

    via: dict[tuple[tuple, Any], int] = {}
    for p in patterns:
        for r in range(1, most + 1):
            arc(0, node["p", p], float(capacity[p]), float(r * r))
        for s in p:
            if s in wanted:
                via[p, s] = arc(node["p", p], node["s", s], float("inf"), 0.0)
    for s in sources:
        arc(node["s", s], 1, float(wanted[s]), 0.0)
    small = 1e-9 * max(1.0, sum(wanted.values()))
    potential = [0.0] * len(out)
    while True:
        distance, reached = [float("inf")] * len(out), [-1] * len(out)
        distance[0] = 0.0
        queue = [(0.0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for e in out[a]:
                if room[e] > small and (to := d + cost[e] + potential[a] - potential[head[e]]) < distance[head[e]] - 1e-12:
                    distance[head[e]], reached[head[e]] = to, e
                    heapq.heappush(queue, (to, head[e]))
        if reached[1] < 0:
            break
        potential = [h + d if d < float("inf") else h for h, d in zip(potential, distance, strict=True)]
        path, at = [], 1
        while at:
            path.append(reached[at])
            at = head[reached[at] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    return {p: {s: room[via[p, s] ^ 1] for s in p if (p, s) in via} for p in patterns}


def _pattern(memberships: Any) -> Column:
    return F.array(F.col("source")) if memberships is None else F.array_sort(F.array_distinct(memberships))


def _spot(seed: int) -> Column:
    """60 bits of an md5, which SQL engines share, of the doc_id, or of the text of a row without one."""
    alone = F.concat(F.lit("text|"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), alone))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _tie() -> Column:
    """The order of unlike texts at one place."""
    return F.xxhash64("text")


def copies(docs: DataFrame) -> DataFrame:
    """`docs` with `held_by`: the sorted sources that hold a row's text, an array that the number of sources bounds."""
    key = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    held = docs.select(key(F.col("text")).alias("key"), "source").distinct().groupBy("key").agg(F.collect_list(F.struct("source")).alias("sources"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(F.col("text")).alias("key"))
    return rows.join(held.select("key", F.array_sort(F.col("sources")["source"]).alias("held_by")), "key").select("row.*", "held_by")


def measured(docs: DataFrame, memberships: Any = None, seed: int = SEED) -> DataFrame:
    """doc_id, pattern (sorted array of sources), size, and the seeded place: `spot`, then `tie`."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", _pattern(memberships).alias("pattern"), size.alias("size"), _spot(seed).alias("spot"), _tie().alias("tie"))


Plan = list[tuple]
PLAN = "pattern array<string>, whole int, source_size array<long>, target array<double>, last_bucket int, limit_spot long, limit_tie long"


def plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MAX_REPEATS) -> Plan:
    """One row per pattern: its whole repetitions, and the place up to which its documents are taken once more."""
    by_bucket = materialize(sized.groupBy("pattern", _bucket().alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    rows = by_bucket.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r["pattern"]): r["words"] for r in rows}
    order = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    own = {s: sum(w for p, w in capacity.items() if s in p) for s in order}
    wanted = targets(own, order, weights, most)
    sent = flow(capacity, wanted, most)
    taken = []
    for p, words in capacity.items():
        through = sum(sent[p].values())
        whole = min(most, int(through // words)) if words else 0
        more = int(through - whole * words + 0.5) if whole < most else 0
        taken.append((list(p), whole, more, [own[s] for s in p], [wanted[s] for s in p]))
    # The bucket in which the words taken once more end, and the words before it.
    shares = F.broadcast(sized.sparkSession.createDataFrame([(t[0], t[2]) for t in taken], "pattern array<string>, more long"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("words")
    ends = by_bucket.withColumn("before", before).join(shares, "pattern").where("before < more and before + words >= more")
    ends = ends.select("pattern", "bucket", "before", "more")
    inside = sized.select("pattern", "spot", "tie", "size", _bucket().alias("bucket")).join(F.broadcast(ends), ["pattern", "bucket"])  # one row a pattern
    # All that is at one place: rows with equal ids and texts, so the window holds no two rows of a place.
    places = inside.groupBy("pattern", "before", "more", "spot", "tie").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy("spot", "tie").rowsBetween(Window.unboundedPreceding, 0))
    # A place is taken if its middle lies before the end, so the sum ends within half of it.
    reached = places.withColumn("upto", F.col("before") + running).where("2 * upto - size <= 2 * more")
    limits = reached.groupBy("pattern").agg(F.max(F.struct("spot", "tie")).alias("limit"))
    marks = {tuple(r["pattern"]): (r["bucket"], r["spot"], r["tie"]) for r in ends.join(limits, "pattern", "left").select("pattern", "bucket", "limit.spot", "limit.tie").collect()}  # at most one row a pattern
    return [(p, whole, own_words, want, *marks.get(tuple(p), (0, None, None))) for p, whole, _, own_words, want in taken]


def _bucket() -> Column:
    return F.shiftright("spot", 48).cast("int")  # 4096 of them


def with_copies(rows: DataFrame, planned: Plan) -> DataFrame:
    """`rows` (pattern, spot, tie, ...) with source_size, target (arrays by the pattern's sources) and copies."""
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(planned, PLAN)), "pattern")  # at most MAX_PATTERNS rows
    reached = (F.col("spot") < F.col("limit_spot")) | ((F.col("spot") == F.col("limit_spot")) & (F.col("tie") <= F.col("limit_tie")))
    again = (_bucket() < F.col("last_bucket")) | ((_bucket() == F.col("last_bucket")) & F.coalesce(reached, F.lit(False)))
    return joined.withColumn("copies", F.col("whole") + again.cast("int")).drop("whole", "last_bucket", "limit_spot", "limit_tie")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), memberships: Any = None, seed: int = SEED, most: int = MAX_REPEATS) -> DataFrame:
    """doc_id, pattern, size, source_size, target (arrays by the pattern's sources), copies and taken for each document.

    `memberships` is a column with the array of a document's sources; by default its one `source`.
    """
    sized = materialize(measured(docs, memberships, seed), "mix")
    out = with_copies(sized, plan(sized, weights, most))
    return out.select("doc_id", "pattern", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), memberships: Any = None, seed: int = SEED, most: int = MAX_REPEATS) -> DataFrame:
    """Each row of `docs`, with all its columns, as often as the mix takes it."""
    planned = plan(materialize(measured(docs, memberships, seed), "mix"), weights, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _pattern(memberships).alias("pattern"), _spot(seed).alias("spot"), _tie().alias("tie"))
    return with_copies(rows, planned).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"), "taken")

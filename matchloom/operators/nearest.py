"""Nearest-neighbour blockers: TF-IDF over character n-grams, and dense vectors.

Exact TF-IDF and dense searches compare shares of the queries with one block of targets after the other, the frequent
grams and the vectors as matrices, and shuffle no pairs (`search`); `tfidf_similarities` gives the same neighbours by
joins. With `lists`, targets are dealt to the nearest of so many centres first, and a
query meets the targets of its nearest centres alone, of as many as a sample of queries needs for the recall that is asked
for; `recall_at` measures what that misses.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAIR, LinkageError
from ..sources.scratch import written
from . import search


def document(fields: tuple[str, ...], separator: str = " ") -> Column:
    """The non-empty stripped fields of a record as one text."""
    parts = [F.regexp_replace(F.coalesce(F.col(f), F.lit("")), r"^\s+|\s+$", "") for f in fields]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), separator)


def char_grams(text: Column, low: int, high: int) -> Column:
    """n-grams inside words padded by a blank on either side; a padded word shorter than n is its own last gram, once."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_size(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))

        # Beyond the first n that covers the whole padded word nothing new comes.
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n <= size) | (n == F.lit(low)))
        return F.flatten(F.transform(sizes, of_size))

    found = F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w != "")
    return F.flatten(F.transform(found, of_word))


def _weights(df: DataFrame, key: str, fields: tuple[str, ...], grams: tuple[int, int]) -> DataFrame:
    text = df.select(key, document(fields).alias("text")).where("text <> ''")
    return text.select(key, F.explode(char_grams(F.col("text"), *grams)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


#: Postings of a record's rarest grams, as a multiple of k, among which its first neighbours are looked for.
SEED = 20
#: Share of the bound below which the grams that are left out must stay: a pair is then completed only if it has the rest.
SPARE = 0.4
#: What rounding of similarities may hide.
NOISE = 1e-8


def _vectors(s1: DataFrame, targets: DataFrame, fields: tuple[str, ...], grams: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(source1_entity_id, gram, w) and (candidate_entity_id, gram, v): weights of length one, by the targets' idf."""
    held = _weights(targets, PAIR[1], fields, grams)
    asked = _weights(s1.withColumnRenamed("entity_id", PAIR[0]), PAIR[0], fields, grams)
    total = held.agg(F.count_distinct(PAIR[1]).alias("n"))
    idf = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row of totals

    def normal(rows: DataFrame, key: str) -> DataFrame:
        raw = rows.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
        norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w"))

    return normal(asked, PAIR[0]), normal(held, PAIR[1]).withColumnRenamed("w", "v")


def _similar(asked: DataFrame, held: DataFrame, name: str) -> DataFrame:
    return asked.join(held, "gram").groupBy(*PAIR).agg(F.sum(F.col("w") * F.col("v")).alias(name))


def _of_pairs(pairs: DataFrame, asked: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """What the grams in `asked` add to the similarity of given pairs."""
    return pairs.select(*PAIR).join(asked.select(PAIR[0], "gram", "w"), PAIR[0]).join(held, [PAIR[1], "gram"]).groupBy(*PAIR).agg(F.sum(F.col("w") * F.col("v")).alias(name))


def _kth(similar: DataFrame, k: int, name: str) -> DataFrame:
    """The pairs of the k highest values of each record, with their place."""
    place = F.row_number().over(Window.partitionBy(PAIR[0]).orderBy(F.desc(name), PAIR[1]))
    return similar.withColumn("place", place).where(F.col("place") <= k)


def tfidf_similarities(asked: DataFrame, held: DataFrame, top_k: int, seed: int = SEED) -> DataFrame:
    """source1_entity_id, candidate_entity_id, similarity: all pairs among which the `top_k` of each record must be.

    A record's grams are ordered from the rarest on. What the grams from any place on can add is bounded by their
    weights times the highest weight that a target has there, and by their norm. The targets that share most by the
    rarest grams are compared whole; the k-th best of them is a lower bound of the k-th best similarity, so the grams from
    the first place on that can't reach it are left out of the index join. What a pair may still gain decides whether it
    is completed.
    """
    stats = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.max("v").alias("most"))
    ordered = Window.partitionBy(PAIR[0]).orderBy("df", "gram")
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)
    before = F.coalesce(F.sum("df").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.least(F.sum(F.col("w") * F.col("most")).over(onward), F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward)))
    grams = written(asked.join(stats, "gram").select(PAIR[0], "gram", "w", before.alias("before"), rest.alias("rest")), "grams")
    first = _kth(_similar(grams.where(F.col("before") < seed * top_k), held, "part"), 2 * top_k, "part")
    known = _kth(_of_pairs(first, asked, held, "known"), top_k, "known")
    bound = known.where(F.col("place") == top_k).select(PAIR[0], (F.col("known") - NOISE).alias("bound"))
    bounded = written(grams.join(bound, PAIR[0], "left").na.fill(0.0, ["bound"]), "bounded-grams")
    is_spare = F.col("rest") < F.lit(SPARE) * F.col("bound")
    needed, spare = bounded.where(~is_spare), bounded.where(is_spare)
    limits = bounded.groupBy(PAIR[0]).agg(F.first("bound").alias("bound"), F.coalesce(F.max(F.when(is_spare, F.col("rest"))), F.lit(0.0)).alias("gain"))
    found = _similar(needed.select(PAIR[0], "gram", "w"), held, "part").join(limits, PAIR[0]).where("part + gain >= bound").select(*PAIR, "part")
    found = written(found, "similar")
    more = _of_pairs(found, spare, held, "more")
    return found.join(more, list(PAIR), "left").select(*PAIR, (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("similarity"))


def _words(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """id, words: those of every id that has some; an id that stands twice has the words of both rows."""
    text = df.select(F.col(key).alias("id"), document(fields).alias("text")).where("text <> ''")
    text = text.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return text.select("id", F.filter(F.split(F.lower("text"), r"\s+", -1), lambda w: w != "").alias("words"))


def _long(best: DataFrame, targets: DataFrame, blocker: str) -> DataFrame:
    sources = targets.select(PAIR[1], F.col("candidate_source").alias("source"))
    return best.join(sources, PAIR[1]).select(*PAIR, "source", F.lit(blocker).alias("blocker"), F.lit(None).cast("array<string>").alias("evidence"), F.col("rank").cast("int").alias("rank"), F.col("similarity").alias("score"))


def tfidf_blocker(s1: DataFrame, targets: DataFrame, fields: tuple[str, ...] = ("name_norm", "address_norm"), ngram_range: tuple[int, int] = (2, 5), top_k: int = 50) -> DataFrame:
    """The `top_k` most similar targets of each record by cosine; similarity 0 is left out after the cut."""
    low, high = ngram_range
    if top_k < 1 or not 1 <= low <= high or not fields:
        raise LinkageError("top_k and n-gram sizes must be positive, and fields given")
    (asked, asking), (held, holding) = (search.classes(_words(df, key, fields), "words") for df, key in ((s1, "entity_id"), (targets, PAIR[1])))
    grams = search.vocabulary(held, low, high)
    vectors = search.sparse_vectors(held, grams, low, high)
    found = written(search.sparse_search(search.dealt(asked), vectors, grams, top_k, low, high), "similar")
    return _long(search.ranked(found, asking, holding, top_k), targets, "tfidf")


#: Fields whose text is embedded, and what stands between them.
DENSE_FIELDS, DENSE_SEPARATOR = ("name_norm", "address_norm", "country"), " | "


def hashed_embedding(dimensions: int = 256, low: int = 2, high: int = 4) -> Callable[[Column], Column]:
    """An embedding that needs no model: signed hashes (32 bits of md5) of character n-grams. Any function from text to vectors can stand in."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}  # a gram's hash, computed once a batch
        padded = [f" {t or ''} ".lower() for t in texts]
        lists = [[known[g] if g in known else known.setdefault(g, int(hashlib.md5(g.encode()).hexdigest()[:8], 16)) for n in range(low, high + 1) for g in (t[i : i + n] for i in range(len(t) - n + 1))] for t in padded]
        hashes = np.fromiter((h for found in lists for h in found), np.int64)
        rows = np.repeat(np.arange(len(lists)), [len(found) for found in lists])
        sums = np.bincount(rows * dimensions + hashes % dimensions, weights=np.where(hashes >> 31, 1.0, -1.0), minlength=len(lists) * dimensions)
        return pd.Series(list(sums.reshape(-1, dimensions).astype(np.float32)), index=texts.index)

    return embed


#: Targets that the centres of an index are fitted on (a bounded sample in md5 order), and rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 20_000, 12


def _unit(values: pd.Series) -> np.ndarray:
    m = np.stack(values.to_numpy()).astype(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _centres(targets: DataFrame, vector: str, lists: int) -> np.ndarray:
    """Centres of unit vectors by spherical k-means over the sample, from its first rows."""
    sample = targets.orderBy(F.md5(F.col(PAIR[1]).cast("binary")), PAIR[1]).limit(FIT_ROWS)
    rows = _unit(sample.select(F.col(vector).cast("array<double>").alias("v")).toPandas()["v"])
    centres = rows[:lists].copy()
    for _ in range(FIT_ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        for c in np.unique(nearest):
            mean = rows[nearest == c].sum(axis=0)
            centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _dealt(df: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """id, v, list: each vector once for each of its `probes` nearest centres."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # lists * dimensions numbers

    def run(batches):
        for batch in batches:
            nearest = np.argsort(-(_unit(batch["v"]) @ shared.value.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), nearest.shape[1]), "v": [v for v in batch["v"] for _ in range(nearest.shape[1])], "list": nearest.ravel()})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, list int")


#: Records whose exact neighbours tell how many lists to probe (in md5 order).
TRIED = 256


def _probes(s1: DataFrame, targets: DataFrame, dealt: DataFrame, centres: np.ndarray, top_k: int, recall: float) -> int:
    """The least number of nearest lists that hold `recall` of the exact neighbours of the tried records."""
    tried = s1.orderBy(F.md5(F.col("id").cast("binary")), "id").limit(TRIED)
    exact = dense_blocker(tried.select(F.col("id").alias("entity_id"), "v"), targets.select(F.col("id").alias(PAIR[1]), "v", F.lit("").alias("candidate_source")), top_k, "v")
    wanted = exact.select(*PAIR).join(dealt.select(F.col("id").alias(PAIR[1]), "list"), PAIR[1]).select(PAIR[0], "list").toPandas()  # TRIED * top_k rows
    rows = tried.select("id", "v").toPandas()
    if rows.empty or wanted.empty:
        return len(centres)
    order = np.argsort(-(_unit(rows["v"]) @ centres.T), axis=1, kind="stable")
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.arange(len(centres))[None, :], axis=1)
    row = {key: i for i, key in enumerate(rows["id"])}
    needed = np.sort(places[wanted[PAIR[0]].map(row).to_numpy(), wanted["list"].to_numpy()])
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def recall_at(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs that were found."""
    hit = exact.select(*PAIR).join(found.select(*PAIR).withColumn("hit", F.lit(1)), list(PAIR), "left")
    return hit.agg(F.count("hit") / F.count(F.lit(1))).first()[0]


def _exact(s1: DataFrame, targets: DataFrame, top_k: int, vector: str, block_rows: int, embed: Callable[[Column], Column] | None, fields: tuple[str, ...]) -> DataFrame:
    """pair, rank, similarity of the nearest targets: all distinct vectors (or embedded texts) are compared."""
    sides = []
    for df, key in ((s1, "entity_id"), (targets, PAIR[1])):
        value = F.col(vector).cast("array<double>") if embed is None else document(fields, DENSE_SEPARATOR)
        found, members = search.classes(df.select(F.col(key).alias("id"), value.alias("v")).where("v is not null"), "v")
        if embed is not None:
            found = found.select("class", embed(F.col("v")).cast("array<double>").alias("v")).where("v is not null")
        sides.append((found, members))
    (asked, asking), (held, holding) = sides
    vectors = search.dense_vectors(held)
    found = written(search.dense_search(search.dealt(asked), vectors, top_k, block_rows), "nearest")
    return search.ranked(found, asking, holding, top_k)


def dense_blocker(
    s1: DataFrame, targets: DataFrame, top_k: int = 50, vector: str = "embedding", block_rows: int = 2048, embed: Callable[[Column], Column] | None = None, fields: tuple[str, ...] = DENSE_FIELDS, lists: int | None = None, recall: float = 0.95
) -> DataFrame:
    """The `top_k` nearest targets of each record by cosine; s1 has entity_id, targets candidate_entity_id.

    Vectors are the column `vector`, or what `embed` makes of the joined fields. The search is exact unless `lists` are
    given: then each record meets the targets of its nearest lists alone, all of them, in blocks, and the number of lists
    follows from the `recall` that is wanted.
    """
    if top_k < 1:
        raise LinkageError("top_k must be positive")
    if lists is None:
        return _long(_exact(s1, targets, top_k, vector, block_rows, embed, fields), targets, "dense")
    if embed is not None:
        s1, targets = (df.withColumn(vector, embed(document(fields, DENSE_SEPARATOR))) for df in (s1, targets))
    sides = [written(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), "vectors") for df, key in ((s1, "entity_id"), (targets, PAIR[1]))]
    named = [side.withColumnRenamed("id", PAIR[1]) for side in sides]
    centres = _centres(named[1], "v", lists)
    dealt = written(_dealt(named[1], PAIR[1], "v", centres, 1), "dealt")
    probes = _probes(*sides, dealt, centres, top_k, recall)
    sides = [written(_dealt(named[0], PAIR[1], "v", centres, probes), "dealt"), dealt]
    counts = [{r["list"]: max(1, math.ceil(r["count"] / block_rows)) for r in side.groupBy("list").count().collect()} for side in sides]  # a row a list

    def blocked(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
        grid = df.sparkSession.createDataFrame([(k, n, other[k]) for k, n in own.items() if k in other], "list int, own int, other int")
        rows = df.join(F.broadcast(grid), "list")  # a row a list
        return rows.withColumn(mine, F.pmod(F.xxhash64("id"), F.col("own")).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("other") - 1))).select("id", "v", "list", "i", "j")

    left = blocked(sides[0], counts[0], counts[1], "i", "j")
    right = blocked(sides[1], counts[1], counts[0], "j", "i")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        plain = lambda ids: np.array(ids.tolist(), dtype=object)
        if a.empty or b.empty:
            return pd.DataFrame({PAIR[0]: np.array([], dtype=object), PAIR[1]: np.array([], dtype=object), "similarity": np.zeros(0)})
        b = b.sort_values("id")
        similar = _unit(a["v"]) @ _unit(b["v"]).T
        k = min(top_k, len(b))
        best = np.argsort(-np.round(similar, 9), axis=1, kind="stable")[:, :k]
        return pd.DataFrame({PAIR[0]: np.repeat(plain(a["id"]), k), PAIR[1]: plain(b["id"])[best.ravel()], "similarity": np.take_along_axis(similar, best, axis=1).ravel()})

    pairs = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(meet, f"{PAIR[0]} string, {PAIR[1]} string, similarity double")
    order = Window.partitionBy(PAIR[0]).orderBy(F.round("similarity", 9).desc(), PAIR[1])
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return _long(best, targets, "dense")

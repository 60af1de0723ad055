r"""Operator 4, language-model scores: the cross-entropy difference of two matched bigram models.

The query scores by models of all words and all bigrams (`lm_corpus.py`), and each document by what they are without its
own counts. The models of this module have a bounded size instead, so that they can be broadcast; the query does not use
them.

Tokens are words `[^\x20\x09-\x0D]+` with A-Z in lower case. The models share one vocabulary, the words that all documents
have `RARE` times or more, from the most frequent ones down to the last count at which no more than `VOCABULARY` have that
count or more (every other word is the unknown word), and one set of bigrams: those that make up `HEAVY` or more of all
tokens, of which there can be no more than 1 / HEAVY. The background model has the counts
of all documents, the target model those of documents labelled quality 1 and toxic 0. A bigram's discounted share is
interpolated with smoothed word frequencies, so both models sum to one over the vocabulary. A document's score is the
mean over its tokens of the target's loss less the background's, in nats: below 0 it resembles the target more.

All counts cover all tokens and are shuffled as partial counts; only the vocabulary and the heavy bigrams, both with a
proven size, reach the driver and the workers.

Cases: null and empty texts have no tokens and null losses and score; equal texts have equal scores; several labels of a
doc_id count if any says target; without target documents the target model is uniform; an empty table gives no rows; a
very long text is one document of all its words, and of a chunk of its own in `lm_corpus.py`; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_corpus
from .common import ascii_lower, documents, materialize, table

VOCABULARY = 65_535
RARE = 2
HEAVY = 2.0**-20
DISCOUNT = 0.5
#: Distinct words, or bigram tokens, that a task holds before it passes its partial counts on.
FLUSH = 1 << 20


def word_counts(docs: DataFrame) -> DataFrame:
    """word_hash, word, n: all words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(ascii_lower(text or "").split())
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Models:
    """The two models; everything in them is bounded by VOCABULARY and 1 / HEAVY."""

    def __init__(self, words: list[bytes], unigrams: np.ndarray, keys: np.ndarray, bigrams: np.ndarray) -> None:
        """`unigrams` (2, words + 1) with the unknown word first, `bigrams` (2, keys): counts of background and target."""
        size = len(words) + 1
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.size = size
        self.keys = keys
        self.words, self.backoff, self.share = [], [], []
        for counts, pairs in zip(unigrams.astype(float), bigrams.astype(float), strict=True):
            self.words.append((counts + 1) / (counts.sum() + size))
            context = np.bincount(keys // size, weights=pairs, minlength=size)
            total = np.maximum(np.maximum(counts, context), 1)
            kept = np.maximum(pairs - DISCOUNT, 0) / total[keys // size]
            self.share.append(kept)
            self.backoff.append(1 - np.bincount(keys // size, weights=kept, minlength=size))

    def losses(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, and the summed loss of each under background and target."""
        lists = [ascii_lower(t or "").split() for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        find = self.ids.get
        ids = np.concatenate([np.fromiter(map(find, words, repeat(0)), np.int64, len(words)) for words in lists] or [np.zeros(0, np.int64)])
        ends = np.cumsum(n)
        previous = np.concatenate([[0], ids[:-1]])[: len(ids)]
        first = np.zeros(len(ids), dtype=bool)
        first[(ends - n)[n > 0]] = True
        keys = previous * self.size + ids
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == keys) & ~first if len(self.keys) else np.zeros(len(ids), dtype=bool)
        sums = []
        for words, backoff, share in zip(self.words, self.backoff, self.share, strict=True):
            p = words[ids]
            rest = ~first
            p[rest] *= backoff[previous[rest]]
            p[hit] += share[at[hit]]
            total = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            sums.append(total[ends] - total[ends - n])
        return n, sums[0], sums[1]


def bigram_counts(docs: DataFrame, ids: Any, size: int) -> DataFrame:
    """key (previous * size + word; -1 - word for words alone), n, n_target over docs (text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = ids.value.get
        parts: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            keys, target = np.concatenate([*parts, np.zeros(0, np.int64)]), np.concatenate([*flags, np.zeros(0, bool)])
            distinct, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, minlength=len(distinct))
            n_target = np.bincount(where, weights=target, minlength=len(distinct)).astype(np.int64)
            parts.clear()
            flags.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(n_target)], names=["key", "n", "n_target"])

        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ascii_lower(text or "").split()
                found = np.fromiter(map(find, words, repeat(0)), np.int64, len(words))
                parts += [-1 - found, found[:-1] * size + found[1:]]
                flags.append(np.full(max(0, 2 * len(words) - 1), bool(target)))
                held += len(words)
                if held >= FLUSH:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, "key long, n long, n_target long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, heavy: float = HEAVY) -> Models:
    spark = docs.sparkSession
    counted = materialize(word_counts(docs).where(F.col("n") >= RARE), "words")
    # How many words have each count: fewer rows than the square root of twice the tokens.
    least, held = None, 0
    for n, words_of_it in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        held += words_of_it
        if held > vocabulary:
            break
        least = n
    chosen = counted.where(F.col("n") >= least).collect() if least else []  # at most `vocabulary` rows
    words = [bytes(r["word"]) for r in sorted(chosen, key=lambda r: (-r["n"], r["word"]))]
    size = len(words) + 1
    ids = spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words)})
    wanted = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    # Labels grow with the documents: the plan that holds at any size is used at every size.
    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = materialize(bigram_counts(flagged, ids, size), "bigrams")
    tokens = counts.where("key < 0").agg(F.sum("n")).first()[0] or 0
    least = max(1.0, heavy * tokens)
    kept = counts.where((F.col("key") < 0) | (F.col("n") >= least)).toPandas()  # at most vocabulary + 1 + 1 / heavy rows
    alone = kept[kept["key"] < 0]
    unigrams = np.zeros((2, size), dtype=np.int64)
    for row, column in enumerate(("n", "n_target")):
        unigrams[row, (-1 - alone["key"]).to_numpy(dtype=np.int64)] = alone[column]
    pairs = kept[kept["key"] >= 0].sort_values("key")
    return Models(words, unigrams, pairs["key"].to_numpy(dtype=np.int64), pairs[["n", "n_target"]].to_numpy(dtype=np.int64).T)


def score_documents(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, background, target = shared.value.losses(part.column(1).to_pylist())
                count = np.maximum(n, 1)
                columns = [pa.array(x / count, pa.float64(), mask=n == 0) for x in (target, background, target - background)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


#: Decimals of the query's losses: what lies beyond depends on the order of floating-point sums.
DIGITS = 9


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses under the models of all rows, and `score` by the held-out losses, under models that lack the row's own counts."""
    scored = lm_corpus.score_corpus(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out=True)
    return scored.select("doc_id", "n_tokens", *[F.round(c, DIGITS).alias(c) for c in scored.columns[2:]])

r"""Scores of a corpus under bigram models of all its words and all its bigrams, which grow with it.

The texts are cut into chunks of about `CHUNK` tokens. A chunk asks for the counts of its distinct words and bigrams, so a
hot one is asked for once a chunk; the questions are shuffled by buckets, whose number grows with the tokens, counted there
as a distributed table, and the answers go back to their chunks. Bigrams of a bucket are those of a range of previous
words, but those of hot previous words (more than 1 / `HOT` of all tokens, so at most `HOT` of them) are spread by ranges
of the word after. A word is known by a hash of 64 bits, and the word after it by 48 bits of its hash. Nothing is cut or
collected; the driver has the hot words and three sums.

Bigrams and words are asked for one after the other, and each answer is a written table, so the questions of only one of
them are on disk at a time.

Held-out losses are those under models that lack the document's own counts: its words and bigrams are taken off all counts
of the background model, and off those of the target model if it is a target document. The vocabulary stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, staged

CHUNK = 1 << 20
#: Tokens for each bucket; what a bucket holds of a chunk is at most its distinct bigrams.
BUCKET = 1 << 21
HOT = 2048
DISCOUNT = 0.5
MOST_ROWS = 1 << 16

STORE, WORDS, PAIRS, TYPES, SUMS, WORD_ANSWERS, PAIR_ANSWERS = range(7)
PART = "kind int, bucket long, chunk long, data binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
HELD_OUT = "held_out_target_loss double, held_out_background_loss double"
#: Tokens whose documents' own counts are in memory at once.
OWN = 1 << 17


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, by planes of their bytes; the first is in order and becomes differences."""
    first = arrays[0].astype(np.uint64)
    rows = np.stack([np.diff(first, prepend=np.uint64(0)), *[a.astype(np.uint64) for a in arrays[1:]]])
    planes = np.ascontiguousarray(np.moveaxis(rows.view(np.uint8).reshape(*rows.shape, 8), 2, 1))
    return np.array(rows.shape, np.int64).tobytes() + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    k, n = np.frombuffer(data[:16], np.int64).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[16:], decompressed_size=8 * k * n, asbytes=True), np.uint8).reshape(k, 8, n)
    rows = np.moveaxis(planes, 1, 2).copy().view(np.uint64).reshape(k, n)
    rows[0] = np.cumsum(rows[0], dtype=np.uint64)
    return rows


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """chunk, ids, lengths, hashes (sorted), stream (places in hashes), heavy: words with 1 / HOT or more of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, made = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {}
        ids: list[int | None] = []
        lists: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            raw = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
            hashes, place = np.unique(raw, return_inverse=True)
            stream = place[np.concatenate([*lists, np.zeros(0, np.int64)])]
            counts = np.bincount(stream, minlength=len(hashes))
            top = np.flatnonzero(counts * HOT >= max(1, len(stream)))
            heavy = [{"h": h, "n": n} for h, n in zip(hashes[top].view(np.int64).tolist(), counts[top].tolist(), strict=True)]
            columns = [pa.array([(part << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in lists]], pa.list_(pa.int64()))]
            columns += [pa.array([pack(hashes)], pa.binary()), pa.array([pack(np.zeros(len(stream)), stream)], pa.binary()), pa.array([heavy], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))]
            made += 1
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "lengths", "hashes", "stream", "heavy"])

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ascii_lower(text or "").split()
                for w in set(words).difference(local):
                    local[w] = len(local)
                ids.append(doc_id)
                lists.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= size or len(ids) >= MOST_ROWS:
                    yield flush()
                    local, ids, lists, held = {}, [], [], 0
        if ids:
            yield flush()

    schema = "chunk long, ids array<long>, lengths array<long>, hashes binary, stream binary, heavy array<struct<h:long,n:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Chunk:
    """A chunk's tokens, its distinct bigrams in order, and their order by buckets."""

    def __init__(self, row: dict) -> None:
        self.hashes = unpack(row["hashes"])[0]
        self.stream = unpack(row["stream"])[1].astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.first = np.ones(len(self.stream), bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        wanted = np.zeros(len(self.lengths), bool)
        wanted[np.array(row["targets"] or [], np.int64)] = True
        self.target = wanted[self.doc]

    def pair(self, hot: np.ndarray, buckets: int) -> Chunk:
        """Find the bigrams; afters are in order within a previous word, also in the order by buckets."""
        size = max(1, len(self.hashes))
        later = np.flatnonzero(~self.first)
        self.pairs, self.inverse = np.unique(self.stream[later - 1] * size + self.stream[later], return_inverse=True)
        self.later = later
        self.v, self.w = self.pairs // size, self.pairs % size
        before = self.hashes[self.v]
        after = self.hashes[self.w] >> np.uint64(16)
        bucket = range_of(np.where(np.isin(before, hot), self.hashes[self.w], before), buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.before, self.after, self.bucket = before[self.order], after[self.order], bucket[self.order]
        return self


def _row(kind: int, bucket: int, chunk: int, *arrays: np.ndarray) -> tuple[int, int, int, bytes]:
    return kind, bucket, chunk, pack(*arrays)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["kind", "bucket", "chunk", "data"])


def _by_bucket(kind: int, chunk: int, bucket: np.ndarray, *arrays: np.ndarray, how: Callable[..., bytes] = pack) -> Iterator[tuple[int, int, int, bytes]]:
    """A row for each bucket; `bucket` is in order."""
    found, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))[: len(starts)].tolist()
    for b, start, end in zip(found.tolist(), starts.tolist(), ends, strict=True):
        yield kind, b, chunk, how(*[a[start:end] for a in arrays])


def pack_pairs(before: np.ndarray, after: np.ndarray, *counts: np.ndarray) -> bytes:
    """Bigrams in order: afters of one previous word become differences, too."""
    rest = after.astype(np.uint64)
    same = before[1:] == before[:-1]
    rest[1:][same] -= after[:-1][same]
    return pack(before, rest, *counts)


def unpack_pairs(data: bytes) -> np.ndarray:
    rows = unpack(data)
    starts = np.ones(rows.shape[1], bool)
    starts[1:] = rows[0][1:] != rows[0][:-1]
    at = np.flatnonzero(starts)
    sums = np.cumsum(rows[1], dtype=np.uint64)
    rows[1] = sums - np.repeat(sums[at] - rows[1][at], np.diff(np.append(at, rows.shape[1])))
    return rows


def _asked(store: DataFrame, rows_of: Callable[[Chunk, int], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch(list(rows_of(Chunk(r), r["chunk"])))

    return store.select("chunk", "lengths", "hashes", "stream", "targets").mapInArrow(run, PART)


def ask_pairs(store: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Rows PAIRS: both words of each distinct bigram of a chunk, and its counts, of all documents and of the target's."""

    def rows(c: Chunk, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
        c.pair(hot, buckets)
        n = np.bincount(c.inverse, minlength=len(c.pairs))[c.order]
        n_target = np.bincount(c.inverse[c.target[c.later]], minlength=len(c.pairs))[c.order]
        return _by_bucket(PAIRS, chunk, c.bucket, c.before, c.after, n, n_target, how=pack_pairs)

    return _asked(store, rows)


def ask_words(store: DataFrame, buckets: int) -> DataFrame:
    """Rows WORDS: hash of each distinct word of a chunk, and its counts and counts before another word, of all and of the target's."""

    def rows(c: Chunk, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
        last = np.append(c.first[1:], True)[: len(c.first)]
        sums = [np.bincount(c.stream[chosen], minlength=len(c.hashes)) for chosen in (slice(None), c.target, ~last, c.target & ~last)]
        return _by_bucket(WORDS, chunk, range_of(c.hashes, buckets), c.hashes, *sums)

    return _asked(store, rows)


def _total(where: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, where, values.astype(np.int64))
    return out


def _of_kind(table: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray]]:
    kinds = table.column("kind").to_numpy()
    chosen = table.take(pa.array(np.flatnonzero(kinds == kind)))
    back = unpack_pairs if kind == PAIRS else unpack
    return chosen.column("chunk").to_pylist(), [back(d) for d in chosen.column("data").to_pylist()]


def count_pairs(asked: DataFrame, buckets: int) -> DataFrame:
    """PAIR_ANSWERS to chunks, and TYPES: how many words follow each previous word."""

    def run(table: pa.Table) -> pa.Table:
        at, rows, start = table.column("bucket")[0].as_py(), [], 0
        chunk, found = _of_kind(table, PAIRS)
        before, after, n, n_target = np.concatenate(found, axis=1)
        _, index, where = np.unique(mixed(before, after), return_index=True, return_inverse=True)
        n, n_target = _total(where, n, len(index)), _total(where, n_target, len(index))
        for c, x in zip(chunk, found, strict=True):
            mine = where[start : start + x.shape[1]]
            rows.append(_row(PAIR_ANSWERS, at, c, np.zeros(len(mine)), n[mine], n_target[mine]))
            start += x.shape[1]
        words, place = np.unique(before[index], return_inverse=True)
        types = np.bincount(place, minlength=len(words))
        types_target = np.bincount(place[n_target > 0], minlength=len(words))
        rows += _by_bucket(TYPES, -1, range_of(words, buckets), words, types, types_target)
        return pa.Table.from_batches([_batch(rows)])

    return asked.groupBy("bucket").applyInArrow(run, PART)


def count_words(asked: DataFrame) -> DataFrame:
    """WORD_ANSWERS: counts of both models, and twice the discounted counts before other words; and SUMS: distinct words, in place of a chunk."""

    def run(table: pa.Table) -> pa.Table:
        at = table.column("bucket")[0].as_py()
        chunk, found = _of_kind(table, WORDS)
        _, types = _of_kind(table, TYPES)
        words, where = np.unique(np.concatenate([x[0] for x in [*found, *types]]), return_inverse=True)
        split = sum(x.shape[1] for x in found)
        n = [_total(where[:split], np.concatenate([x[i] for x in found]), len(words)) for i in range(1, 5)]
        t = [_total(where[split:], np.concatenate([x[i] for x in types] or [np.zeros(0)]), len(words)) for i in (1, 2)]
        values = [n[0], n[1], 2 * n[2] - t[0], 2 * n[3] - t[1]]
        rows, start = [(SUMS, at, len(words), b"")], 0
        for c, x in zip(chunk, found, strict=True):
            mine = where[start : start + x.shape[1]]
            rows.append(_row(WORD_ANSWERS, at, c, np.zeros(len(mine)), *[v[mine] for v in values]))
            start += x.shape[1]
        return pa.Table.from_batches([_batch(rows)])

    return asked.groupBy("bucket").applyInArrow(run, PART)


def held_out_losses(c: Chunk, counts: np.ndarray, pairs: np.ndarray, sums: tuple[int, int, int]) -> list[np.ndarray]:
    """Summed losses of each document under background and target, without its own counts; documents go in slices."""
    size, kinds = max(1, len(c.hashes)), max(1, len(c.pairs))
    out = [np.zeros(len(c.lengths)) for _ in range(2)]
    ends = np.cumsum(c.lengths)
    is_target = np.zeros(len(c.lengths), bool)
    is_target[c.doc[c.target]] = True
    a = 0
    while a < len(c.lengths):
        start = ends[a] - c.lengths[a]
        b = max(a + 1, int(np.searchsorted(ends, start + OWN, side="right")))
        stop = ends[b - 1]
        doc, stream = c.doc[start:stop] - a, c.stream[start:stop]
        words, word = np.unique(doc * size + stream, return_inverse=True)
        n_word = np.bincount(word, minlength=len(words))
        low, high = np.searchsorted(c.later, (start, stop))
        later = c.later[low:high] - start
        bigrams, first, bigram = np.unique(doc[later] * kinds + c.inverse[low:high], return_index=True, return_inverse=True)
        n_bigram = np.bincount(bigram, minlength=len(bigrams))
        previous = word[later - 1]
        n_before = np.bincount(previous, minlength=len(words))
        for m in range(2):
            mine = np.ones(b - a) if m == 0 else is_target[a:b].astype(float)
            all_of = counts[m][words % size] - mine[words // size] * n_word
            together = pairs[m][bigrams % kinds] - mine[bigrams // kinds] * n_bigram
            alone = mine[bigrams // kinds] * (together == 0)  # words that follow in this document only
            alone = np.bincount(previous[first], weights=alone, minlength=len(words))
            discounted = counts[2 + m][words % size] - 2 * mine[words // size] * n_before + alone
            total = np.maximum(all_of, 1)
            tokens = sums[1 + m] - mine * c.lengths[a:b]
            own = (all_of + 1) / (tokens[words // size] + sums[0])
            p = own[word]
            p[later] = p[later] * (1 - DISCOUNT * discounted / total)[previous] + np.maximum(together - DISCOUNT, 0)[bigram] / total[previous]
            out[m][a:b] = np.bincount(doc, weights=-np.log(p), minlength=b - a)
        a = b
    return out


def score_chunks(parts: DataFrame, hot: np.ndarray, buckets: int, sums: tuple[int, int, int], held_out: bool = False) -> DataFrame:
    """The scores of the documents of each chunk, from its STORE row and all its answers."""
    schema = f"{SCORES}, {HELD_OUT}" if held_out else SCORES

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        whole = table.filter(pa.compute.equal(table.column("kind"), STORE)).to_pylist()[0]
        c = Chunk(whole).pair(hot, buckets)
        answer = lambda kind, k: np.concatenate([np.zeros((k, 0)), *_of_kind(table, kind)[1]], axis=1)[1:].astype(float)
        counts = answer(WORD_ANSWERS, 5)
        pairs = np.empty((2, len(c.pairs)))
        pairs[:, c.order] = answer(PAIR_ANSWERS, 3)
        losses = []
        for m in range(2):
            own = (counts[m] + 1) / (sums[1 + m] + sums[0])
            total = np.maximum(counts[m], 1)
            backoff = 1 - DISCOUNT * counts[2 + m] / total
            loss = -np.log(own)[c.stream]
            p = own[c.w] * backoff[c.v] + np.maximum(pairs[m] - DISCOUNT, 0) / total[c.v]
            loss[c.later] = -np.log(p)[c.inverse]
            losses.append(np.bincount(c.doc, weights=loss, minlength=len(c.lengths)) / np.maximum(c.lengths, 1))
        background, target = losses
        columns = [target, background, target - background]
        if held_out:
            background, target = (x / np.maximum(c.lengths, 1) for x in held_out_losses(c, counts, pairs, sums))
            columns = [*columns[:2], target - background, target, background]
        arrays = [pa.array(x, pa.float64(), mask=c.lengths == 0) for x in columns]
        return pa.Table.from_arrays([pa.array(whole["ids"], pa.int64()), pa.array(c.lengths), *arrays], names=[x.split()[0] for x in schema.split(", ")])

    return parts.groupBy("chunk").applyInArrow(run, schema)


def _marked(docs: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """The chunks as a written table, each with the places of its target documents."""
    store, at = staged(chunks(docs, chunk), "chunks")
    wanted = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("id")).distinct()
    # Labels grow with the documents: the plan that holds at any size is used at every size.
    places = store.select("chunk", F.posexplode("ids").alias("pos", "id")).join(wanted.hint("merge"), "id")
    marks = places.groupBy("chunk").agg(F.collect_list("pos").alias("targets"))
    marked = materialize(store.join(marks.hint("merge"), "chunk", "left"), "marked-chunks")
    discard(docs.sparkSession, [at])
    return marked


def score_corpus(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, bucket: int = BUCKET, held_out: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row, under the models of all rows.

    With `held_out` both losses are also given under models without the row's own counts, and `score` is their difference.
    """
    store = _marked(docs, labels, chunk)
    all_of = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    target_of = F.aggregate(F.coalesce("targets", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, p: a + F.get("lengths", p))
    tokens, target = (n or 0 for n in store.select(F.sum(all_of), F.sum(target_of)).first())
    buckets = -(-tokens // bucket) or 1
    # A word that has 2 / HOT of all tokens has half of them in chunks where it has 1 / HOT or more.
    heavy = store.select(F.inline("heavy")).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * HOT >= tokens).collect()
    hot = np.array([r["h"] for r in heavy], np.int64).view(np.uint64)
    pairs = materialize(count_pairs(ask_pairs(store, hot, buckets), buckets), "pair-counts")
    words = materialize(count_words(ask_words(store, buckets).unionByName(pairs.where(F.col("kind") == TYPES))), "word-counts")
    distinct = words.where(F.col("kind") == SUMS).agg(F.sum("chunk")).first()[0] or 0
    answers = pairs.where(F.col("kind") == PAIR_ANSWERS).unionByName(words.where(F.col("kind") == WORD_ANSWERS))
    stored = store.select(F.lit(STORE).alias("kind"), F.lit(-1).cast("long").alias("bucket"), "chunk", "ids", "lengths", "hashes", "stream", "targets")
    return score_chunks(stored.unionByName(answers, allowMissingColumns=True), hot, buckets, (distinct, tokens, target), held_out)

"""Exact nearest neighbours without a shuffle of pairs: each task holds a share of the queries and reads all targets.

Targets are written once into the shared folder and read a block at a time; a task keeps the best k of each of its
queries and nothing else. Equal values are one class, which is searched and found once; classes are numbered in the order
of their least ids, so that ties go by id as they do between records.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAIR
from ..sources.scratch import staged, written

#: Queries of a task, rows of its first block (which only has to give a bound) and of the others.
TASK_ROWS, FIRST_ROWS, BLOCK_ROWS = 4096, 2048, 24_576
#: Grams in the matrix of a block, and queries that meet it at once.
FREQUENT, SOME = 384, 256
#: What rounding of similarities may hide, and that of sums of single precision.
NOISE, COARSE = 1e-8, 1e-5


def classes(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(class, value, n) of the distinct values, written, and (class, id) of the rows (id, value)."""
    counted = rows.groupBy(value).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("least")
    found = written(counted.select(F.monotonically_increasing_id().alias("class"), value, "n"), "classes")
    return found, written(rows.join(found.select("class", value), value).select("class", "id"), "members")


def dealt(queries: DataFrame) -> DataFrame:
    """Queries in shares of about TASK_ROWS, or fewer for all cores to have some."""
    return queries.repartition(max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() / TASK_ROWS)), "class")


def ranked(found: DataFrame, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """The pair, rank and similarity of the best `k` ids, of found classes (asked, held, similarity) and members."""
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    first = held.withColumn("place", place).where(F.col("place") <= k).select(F.col("class").alias("held"), F.col("id").alias(PAIR[1]))
    order = Window.partitionBy("asked").orderBy(F.round("similarity", 9).desc(), PAIR[1])
    best = found.join(first, "held").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("class").alias("asked"), F.col("id").alias(PAIR[0])), "asked").select(*PAIR, "rank", "similarity")


def _uri(path: str) -> str:
    return f"file://{path.removeprefix('file:')}" if path.startswith(("/", "file:/")) and not path.startswith("file://") else path


def _batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import dataset, fs

    system, folder = fs.FileSystem.from_uri(path)
    yield from dataset.dataset(folder, filesystem=system, format="parquet").to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False)


def _blocks(path: str, first: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table in blocks of about `rows`, after a first one of `first`."""
    held, n, wanted = [], 0, first
    for batch in _batches(path, min(first, rows)):
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= wanted:
            yield pa.concat_batches(held)
            held, n, wanted = [], 0, rows
    if held:
        yield pa.concat_batches(held)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    held = [b for b in batches if b.num_rows]
    return pa.concat_batches(held) if held else None


# Sparse vectors


def _grams(words: list[str], low: int, high: int) -> list[str]:
    """n-grams of words padded by a blank on either side; a padded word shorter than n is its own last gram, once."""
    out = []
    for word in words:
        padded = f" {word} "
        out += [padded[i : i + n] for n in range(low, high + 1) if n <= len(padded) or n == low for i in range(max(len(padded) - n + 1, 1))]
    return out


class Vocabulary:
    """The grams of the targets, numbered from the rarest on, with their idf."""

    def __init__(self, path: str) -> None:
        table = pa.Table.from_batches(list(_batches(path, 1 << 20)), schema=pa.schema([("gram", pa.string()), ("df", pa.int64()), ("idf", pa.float64())])).sort_by([("df", "ascending"), ("gram", "ascending")])
        self.number = {g: i for i, g in enumerate(table["gram"].to_pylist())}
        self.idf = table["idf"].to_numpy()

    def vector(self, words: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in ascending order and weights of length one."""
        counts = Counter(self.number[g] for g in _grams(words, low, high) if g in self.number)
        ids = np.fromiter(counts.keys(), np.int32, len(counts))
        weights = np.fromiter(counts.values(), float, len(counts)) * self.idf[ids]
        order = np.argsort(ids)
        return ids[order], weights[order] / (math.sqrt(weights @ weights) or 1.0)


def vocabulary(targets: DataFrame, low: int, high: int) -> str:
    """Where the grams of target classes (words, n) are written, with the number of targets that have them and their idf."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for words, n in zip(batch["words"].to_pylist(), batch["n"].to_pylist(), strict=True):
                for g in set(_grams(words, low, high)):
                    found[g] += n
        yield pa.record_batch([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    df = targets.select("words", "n").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))
    total = F.broadcast(targets.agg(F.sum("n").alias("total")))  # one row
    return _uri(staged(df.crossJoin(total).select("gram", "df", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")[1])


def sparse_vectors(targets: DataFrame, vocabulary: str, low: int, high: int) -> str:
    """Where the vectors of target classes (class, ids, w) are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Vocabulary(vocabulary)
            made = [known.vector(words, low, high) for words in batch["words"].to_pylist()]
            yield pa.record_batch([batch["class"], pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["class", "ids", "w"])

    return _uri(staged(targets.select("class", "words").mapInArrow(run, "class long, ids array<int>, w array<double>"), "vectors")[1])


def _best(numbers: np.ndarray, similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(similar) > 4 * k:
        near = similar >= np.partition(similar, -k)[-k] - NOISE
        numbers, similar = numbers[near], similar[near]
    order = np.lexsort((numbers, -np.round(similar, 9)))[:k]
    return numbers[order], similar[order]


class SparseBlock:
    """Vectors of a block of targets: the most frequent grams as a matrix, which has nearly all products, the others by gram."""

    def __init__(self, batch: pa.RecordBatch, size: int, frequent: int) -> None:
        self.numbers = batch["class"].to_numpy()
        self.offsets, self.ids = _lists(batch["ids"])
        self.w = _lists(batch["w"])[1]
        self.head = max(size - frequent, 0)  # grams from this number on are in the matrix
        row, often = np.repeat(np.arange(len(self.numbers)), np.diff(self.offsets)), self.ids >= self.head
        self.matrix = np.zeros((len(self.numbers), size - self.head), np.float32)
        self.matrix[row[often], self.ids[often] - self.head] = self.w[often]
        rare = self.ids[~often]
        order = np.argsort(rare, kind="stable")
        self.rows, self.v = row[~often][order], self.w[~often][order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=self.head))])
        self.query = np.zeros(size)

    def coarse(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent grams give each query with each row, in single precision."""
        left = np.zeros((len(asked), self.matrix.shape[1]), np.float32)
        for i, (ids, w) in enumerate(asked):
            at = np.searchsorted(ids, self.head)
            left[i, ids[at:] - self.head] = w[at:]
        return left @ self.matrix.T

    def add(self, similar: np.ndarray, ids: np.ndarray, w: np.ndarray) -> None:
        """Add what given rare grams give each row."""
        starts, ends = self.starts[ids], self.starts[ids + 1]
        spans = [slice(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e > s]
        if spans:
            products = np.concatenate([self.v[s] for s in spans])
            products *= np.repeat(w, ends - starts)
            similar += np.bincount(np.concatenate([self.rows[s] for s in spans]), products, len(self.numbers))

    def whole(self, ids: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The similarity of given rows."""
        self.query[ids] = w
        starts, sizes = self.offsets[rows], self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        out = np.add.reduceat(self.query[self.ids[at]] * self.w[at], ends - sizes)
        self.query[ids] = 0
        return out

    def search(self, similar: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, bound: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a similarity above 0, all among them that reach the bound (else the best k), and their similarities.

        Sums of single precision, 0 only where no gram is shared, say which rows these may be.
        """
        rare = np.searchsorted(ids, self.head)
        if rare:
            self.add(similar, ids[:rare], w[:rare])
        if bound is None:
            bound = float(np.partition(similar, -k)[-k]) - COARSE if len(similar) > k else 0.0
        rows = np.flatnonzero(similar >= max(bound - COARSE, np.finfo(np.float32).tiny))
        return (rows, self.whole(ids, w, rows)) if len(rows) else (rows, np.zeros(0))


def sparse_search(queries: DataFrame, vectors: str, vocabulary: str, k: int, low: int, high: int, first: int = FIRST_ROWS, rows: int = BLOCK_ROWS, frequent: int = FREQUENT) -> DataFrame:
    """asked, held, similarity: the best `k` target classes of each query class (class, words), all similarities above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _columns(batches)
        if mine is None:
            return
        known = Vocabulary(vocabulary)
        asked = [known.vector(words, low, high) for words in mine["words"].to_pylist()]
        size = len(known.idf)
        del known
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        for batch in _blocks(vectors, first, rows):
            block = SparseBlock(batch, size, frequent)
            for start in range(0, len(asked), SOME):
                for i, similar in enumerate(block.coarse(asked[start : start + SOME]), start):
                    (ids, w), (numbers, values) = asked[i], best[i]
                    found, exact = block.search(similar, ids, w, k, values[-1] - NOISE if len(values) == k else None)
                    if len(found):
                        best[i] = _best(np.concatenate([numbers, block.numbers[found]]), np.concatenate([values, exact]), k)
            del block
        yield _found(mine["class"].to_numpy(), [b[0] for b in best], [b[1] for b in best])

    return queries.select("class", "words").mapInArrow(run, "asked long, held long, similarity double")


def _found(asked: np.ndarray, held: list[np.ndarray], similar: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.repeat(asked, [len(h) for h in held])), pa.array(np.concatenate(held).astype(np.int64)), pa.array(np.concatenate(similar).astype(float))], names=["asked", "held", "similarity"])


# Dense vectors


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of length one."""
    m = _lists(batch["v"])[1].reshape(batch.num_rows, -1).astype(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def dense_vectors(targets: DataFrame) -> str:
    """Where the vectors of target classes (class, v) are written."""
    return _uri(staged(targets.select("class", "v"), "vectors")[1])


def dense_search(queries: DataFrame, vectors: str, k: int, rows: int) -> DataFrame:
    """asked, held, similarity: the best `k` target classes of each query class (class, v) by cosine.

    Single precision says which pairs may be among the best; these alone are computed in double precision.
    """
    some = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _columns(batches)
        if mine is None:
            return
        asked = _matrix(mine)
        coarse = asked.astype(np.float32)
        numbers, similar = np.full((len(asked), k), -1), np.full((len(asked), k), -np.inf)
        for batch in _blocks(vectors, rows, rows):
            held = _matrix(batch)
            across, of = np.ascontiguousarray(held.astype(np.float32).T), batch["class"].to_numpy()
            for start in range(0, len(asked), some):
                part = slice(start, start + some)
                sums = coarse[part] @ across
                least = similar[part, -1]
                if len(of) > k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(sums, len(of) - k, axis=1)[:, len(of) - k])
                i, j = np.nonzero(sums >= (least - COARSE).astype(np.float32)[:, None])
                if not len(i):
                    continue
                exact = np.concatenate([np.einsum("ij,ij->i", asked[start + i[a : a + 16384]], held[j[a : a + 16384]]) for a in range(0, len(i), 16384)])
                n = len(sums)
                row = np.concatenate([np.repeat(np.arange(n), k), i])
                number, value = np.concatenate([numbers[part].ravel(), of[j]]), np.concatenate([similar[part].ravel(), exact])
                order = np.lexsort((number, -np.round(value, 9), row))
                place = np.arange(len(order)) - np.searchsorted(row[order], np.arange(n))[row[order]]
                order = order[place < k]
                numbers[part], similar[part] = number[order].reshape(n, k), value[order].reshape(n, k)
        there = numbers >= 0
        yield _found(mine["class"].to_numpy(), [x[t] for x, t in zip(numbers, there, strict=True)], [x[t] for x, t in zip(similar, there, strict=True)])

    return queries.select("class", "v").mapInArrow(run, "asked long, held long, similarity double")

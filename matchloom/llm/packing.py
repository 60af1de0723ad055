"""Operator 3, best-fit packing: a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most `capacity` counts) reaches the driver. There a covering program over
configurations (multisets of lengths that fit one sequence) is solved by multiplicative weights: every length has a
price, a knapsack dynamic program finds the configuration of the highest total price, some copies of it are taken, and
the prices of what it covers fall. Fractions are rounded down, and what stays open is closed by decreasing lengths, the
longest that fits first. The prices also give a lower bound (the dual of the program) on the sequences that any packing
needs; as long as the packing exceeds it by more than `GAP`, what stayed open goes through the program again, and the
best closing counts. The result is a list of runs: the pieces of one length with ranks [lo, hi) go to consecutive
sequences at one offset. Each piece then finds its run by a binary search, in parallel.

Cases: a null or empty text is one piece that holds the end id; repeated rows and equal doc_ids are packed one by one;
null doc_ids stay null; an empty table gives no rows; a very long text is cut into pieces as it is encoded, whole; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
#: Pricing steps of one pass over the program.
STEPS = 160
#: Share of the lower bound by which a packing may exceed it.
GAP = 0.0005

Configuration = tuple[tuple[int, int], ...]


def price(values: np.ndarray, available: np.ndarray, capacity: int) -> tuple[Configuration, float]:
    """The configuration of highest value by a knapsack dynamic program over all capacities, and that value.

    `values[l]` is the price of length l. Copies beyond `available` are dropped from the found configuration, and what
    they held is refilled greedily; the value is that of the configuration as found.
    """
    sizes = np.flatnonzero(available[: capacity + 1] > 0)
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    worth = values[sizes]
    usable = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], 0
        if k := usable[c]:
            total = best[c - sizes[:k]] + worth[:k]
            at = int(total.argmax())
            if total[at] > best[c]:
                best[c], choice[c] = total[at], sizes[at]
    taken: dict[int, int] = {}
    c = capacity
    while c > 0:
        length = int(choice[c])
        if not length:
            c -= 1
            continue
        taken[length] = taken.get(length, 0) + 1
        c -= length
    taken = {length: min(n, int(available[length])) for length, n in taken.items()}
    room = capacity - sum(length * n for length, n in taken.items())
    while room > 0 and (k := int(np.searchsorted(sizes, room, side="right"))):
        fits = [int(x) for x in sizes[:k][::-1] if available[x] > taken.get(int(x), 0)][:1]
        if not fits:
            break
        taken[fits[0]] = taken.get(fits[0], 0) + 1
        room -= fits[0]
    return tuple(sorted(taken.items())), float(best[capacity])


def close(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """All open pieces by decreasing lengths: the longest, then again and again the longest that fits, as often as it can be repeated."""
    left, out = left.copy(), []
    sizes = np.flatnonzero(left).tolist()
    while sizes:
        content: dict[int, int] = {}
        room, upto = capacity, len(sizes)
        while upto:
            length = sizes[upto - 1]
            if length <= room and (copies := min(room // length, int(left[length]))):
                content[length] = copies
                room -= copies * length
            upto = bisect.bisect_right(sizes, min(room, length - 1))
        n = min(int(left[length]) // copies for length, copies in content.items())
        out.append((tuple(sorted(content.items())), n))
        for length, copies in content.items():
            left[length] -= copies * n
        sizes = [length for length in sizes if left[length]] if any(not left[length] for length in content) else sizes
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS, gap: float = GAP) -> list[tuple[Configuration, int]]:
    """Configurations and how many sequences use each; together they hold every piece exactly once."""
    left = counts.astype(np.int64).copy()
    packed: dict[Configuration, int] = {}

    def take(config: Configuration, n: int) -> None:
        packed[config] = packed.get(config, 0) + n
        for length, copies in config:
            left[length] -= copies * n

    bound = float(counts @ np.arange(capacity + 1)) / capacity
    if left[capacity]:  # full pieces fill a sequence each
        take(((capacity, 1),), int(left[capacity]))
    best: tuple[float, dict[Configuration, int], list[tuple[Configuration, int]]] = (np.inf, dict(packed), [])
    while left.any():
        open_before = left.sum()
        prices = np.arange(capacity + 1) / capacity
        fraction: dict[Configuration, float] = {}
        for _ in range(min(steps, int(open_before))):
            config, value = price(prices, left, capacity)
            bound = max(bound, float(counts[left > 0] @ prices[left > 0]) / value)
            share = 0.5 * min(left[length] / copies for length, copies in config)
            fraction[config] = fraction.get(config, 0.0) + share
            for length, copies in config:
                prices[length] *= np.exp(-2.0 * copies * share / left[length])
        for config, x in sorted(fraction.items(), key=lambda item: (-item[1], item[0])):
            n = min(int(x), *(int(left[length]) // copies for length, copies in config))
            if n > 0:
                take(config, n)
        closing = close(left, capacity)
        total = sum(packed.values()) + sum(n for _, n in closing)
        if total < best[0]:
            best = (total, dict(packed), closing)
        if best[0] <= max(bound * (1 + gap), np.ceil(bound - 1e-6)) or left.sum() == open_before:
            break  # near the bound, or less than one sequence of any configuration is left
    packed = best[1]
    for config, n in best[2]:
        packed[config] = packed.get(config, 0) + n
    return sorted(packed.items())


def runs(solution: list[tuple[Configuration, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by the first two: where the ranks of a length go."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, n in solution:
        offset = 0
        for length, copies in reversed(config):
            for _ in range(copies):
                rows.append((length, rank.get(length, 0), sequence, offset))
                rank[length] = rank.get(length, 0) + n
                offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents; (part, length, idx) numbers the pieces of a length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        step = 4 * capacity
        for batch in slices(batches):
            keys, raws = batch.column(0).to_pylist(), codes.encode(batch.column(1).to_pylist())
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for key, raw in zip(keys, raws, strict=True):
                raw += tail
                for piece, at in enumerate(range(0, len(raw), step)):
                    ids = raw[at : at + step]
                    length = len(ids) // 4
                    for column, value in zip(rows, (key, piece, at // 4, length, zlib.crc32(ids), seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(rows, kinds, strict=True)]
            columns.insert(5, pa.array([part] * len(rows[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "idx"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def place(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Sequence and offset of each row of `pieces` (length, part, idx and any more columns), a materialized table."""
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_part.select("part", "length", before.alias("base"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    where = runs(solve(counts, capacity, steps))
    span = 1 << 48
    keys = where[:, 0] * span + where[:, 1]
    columns = [c for c in pieces.columns if c not in ("part", "idx")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = where[at, 2] + rank - where[at, 1]
            kept = [batch.column(names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(where[at, 3], pa.int64())], names=[*columns, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("idx")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*columns).schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of `docs` (doc_id, text)."""
    return place(materialize(cut(docs, tokenizer or default_tokenizer(), end_id, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

"""Operator 5, token ids as files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents in a succinct form. Level k of the matrix is a bit-plane with the k-th
highest bit of every id, in the order that a stable partition by the bits above gives; a directory of counts makes
rank constant in time, and select a binary search. From one compressed file a reader can get any token (`access`),
count an id in a span (`rank`, `count`), find its occurrences (`select`, `occurrences`) and restore all ids (`tokens`).

File: magic `WVM2`, then, little-endian, eight int64 (version, tokens, documents, levels, directory block in bits, segment
in bytes, size of the head, zero) and the compressed size (uint32) of each segment of each plane. The head, one zstd frame,
has doc_id int64 per document, one null flag byte per document, length uint32 per document, zeros int64 per level, and the
directory (uint32 ones before each block) of each level. Behind it stand the segments of the planes (highest bit first), a
zstd frame each, so a reader that wants one token fetches one segment a level.

Cases: a null text has the end id alone; a null doc_id comes first and stays null; equal doc_ids and repeated rows each
keep their own place, in any order among themselves; an empty table gives no shard and no rows; a very long text stands
whole in one shard, which may exceed `SHARD_TOKENS` by it; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices, stage_path
from .tokens import default_tokenizer, encoder

MAGIC = b"WVM2"
BLOCK = 1024
#: Bytes of a plane that are compressed together; a multiple of a directory block.
SEGMENT = 8192
#: Tokens after which a shard is closed; a single longer document makes a longer shard.
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of ids."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for k in range(levels - 1, -1, -1):
            bits = (current & current.dtype.type(1 << k)) != 0
            plane = np.packbits(bits)
            padded = np.zeros(-(-len(ids) // BLOCK) * (BLOCK // 8), dtype=np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            following = np.empty_like(current)
            upper = np.compress(bits, current)
            zero = len(current) - len(upper)
            following[zero:] = upper
            np.compress(~bits, current, out=following[:zero])
            zeros.append(zero)
            current = following
        return cls(len(ids), planes, ranks, zeros)

    def tokens(self) -> np.ndarray:
        """All ids: the partitions undone from the lowest level up."""
        out = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for k, (plane, zero) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~bits)] = out[:zero]  # by position: three times as fast as by mask
            above[np.flatnonzero(bits)] = out[zero:] | out.dtype.type(1 << k)
            out = above
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i."""
        block = i // BLOCK
        start = block * (BLOCK // 8)
        whole = self.planes[level][start : i >> 3]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(whole).sum(dtype=np.int64))
        return count + (int(self.planes[level][i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, end: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        first = 0
        for level in range(self.levels):
            a, b = self._ones(level, first), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                first, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, end = first - a, end - b
        return first, end

    def rank(self, token: int, end: int) -> int:
        """How often the token stands before position `end`."""
        first, last = self._span(token, end)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th (from 0) occurrence."""
        first, end = self._span(token, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        i = first + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


class Segments:
    """A plane whose segments are fetched when a bit or a block in them is asked for; the last ones stay."""

    def __init__(self, fetch: Callable[[int], bytes]) -> None:
        self.fetch = functools.lru_cache(4)(fetch)

    def __getitem__(self, key: int | slice) -> Any:
        first = key.start if isinstance(key, slice) else key
        held, at = np.frombuffer(self.fetch(first // SEGMENT), np.uint8), first // SEGMENT * SEGMENT
        return held[key.start - at : key.stop - at] if isinstance(key, slice) else held[key - at]


class Shard:
    """What a file holds: documents with their lengths, and the matrix of their ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> None:
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def to_bytes(self) -> bytes:
        import zstandard

        pack, m = zstandard.ZstdCompressor(level=1).compress, self.matrix
        parts = [np.array([d or 0 for d in self.doc_ids], "<i8"), np.array([d is None for d in self.doc_ids], np.uint8), np.asarray(self.lengths, "<u4"), np.array(m.zeros, "<i8"), *m.ranks]
        head = pack(b"".join(x.tobytes() for x in parts))
        frames = [pack(plane[at : at + SEGMENT].tobytes()) for plane in m.planes for at in range(0, len(plane), SEGMENT)]
        numbers = np.array([2, m.n, len(self.doc_ids), m.levels, BLOCK, SEGMENT, len(head), 0], "<i8")
        return b"".join([MAGIC, numbers.tobytes(), np.array([len(f) for f in frames], "<u4").tobytes(), head, *frames])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> Shard:
        """A shard over `read(start, size)` of its file: its head is read now, segments of planes when they are needed."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        if (begin := read(0, 68))[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        _, n, docs, levels, block, segment, head, _ = np.frombuffer(begin, "<i8", 8, 4).tolist()
        per_plane = -(-(-(-n // 8)) // segment)
        sizes = np.frombuffer(read(68, 4 * levels * per_plane), "<u4").astype(np.int64)
        starts = 68 + 4 * len(sizes) + head + np.append(0, np.cumsum(sizes))
        raw, at = unpack(read(68 + 4 * len(sizes), head)), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        doc_ids, nulls = take("<i8", docs).tolist(), take("u1", docs)
        lengths, zeros = take("<u4", docs), take("<i8", levels).tolist()
        ranks = [take("<u4", -(-n // block) + 1) for _ in range(levels)]

        def plane(level: int) -> Segments:
            return Segments(lambda k: unpack(read(int(starts[level * per_plane + k]), int(sizes[level * per_plane + k]))))

        shard = cls([None if null else d for d, null in zip(doc_ids, nulls, strict=True)], lengths, WaveletMatrix(n, [plane(k) for k in range(levels)], ranks, zeros))
        shard.segments = per_plane
        return shard

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        """The whole shard in memory."""
        shard = cls.open(lambda start, size: data[start : start + size])
        planes = [np.frombuffer(b"".join(plane.fetch(k) for k in range(shard.segments)), np.uint8) for plane in shard.matrix.planes]
        return cls(shard.doc_ids, shard.lengths, WaveletMatrix(shard.matrix.n, planes, shard.matrix.ranks, shard.matrix.zeros))


def open_shard(uri: str) -> Shard:
    """The shard of a file, of which only what is asked for is read."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return Shard.open(lambda start, size: file.read_at(size, start))


def _write(uri: str, data: bytes) -> None:
    """Names hold the number of the try, so a task that dies leaves part of a file under a name that no manifest lists."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_output_stream(path) as out:
        out.write(data)


def _read(uri: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as got:
        return got.read()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write `docs` (doc_id, text) in ascending doc_id into `folder`, a URI that all executors reach.

    Returns the manifest: part, seq (their order is that of the documents), path, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        codes, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        rows: list[tuple[int, int, str, int, int]] = []
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def close() -> None:
            nonlocal held
            path = f"{folder}/shard-{part:06d}-{len(rows):06d}-{attempt}.wvm"
            shard = Shard(list(keys), np.array([len(x) // 4 for x in ids]), WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4")))
            _write(path, shard.to_bytes())
            rows.append((part, len(rows), path, len(keys), held))
            ids.clear()
            keys.clear()
            held = 0

        for batch in slices(batches):
            for key, raw in zip(batch.column(0).to_pylist(), codes.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                ids.append(raw + tail)
                held += len(raw) // 4 + 1
                if held >= shard_tokens:
                    close()
        if keys:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # Tokens before each part (one row a part), then inside every part before each of its shards: no task orders all shards.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("path", (F.col("ahead") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard.from_bytes(_read(path))
                raw = shard.matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, **options: Any) -> DataFrame:
    docs = documents(spark, sf_dir)
    return read_shards(write_shards(docs, _folder(spark), tokenizer or default_tokenizer(), 1, **options))


def _folder(spark: SparkSession) -> str:
    """A new folder; object stores need none, local paths do."""
    from pyarrow import fs

    uri = stage_path(spark, "wavelet")
    uri = uri if "://" in uri else "file://" + uri
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path)
    return uri

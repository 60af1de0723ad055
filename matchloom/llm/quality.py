"""Operator 1, a quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by one filter width less a byte, so that every window of the
whole document lies in exactly one chunk. Learned filters slide over the bytes; each chunk keeps every filter's maximum
(rectified), and the maximum and mean of these over all chunks go through a logistic layer to one probability. As a
filter's weights belong to (place, byte) pairs, a response is a sum of table rows and needs no multiplication.

Training takes a bounded sample: `SAMPLE` rows per class from the labelled rows outside the held-out fifth, in order of
a hash of doc_id, of at most `SAMPLE_BYTES` bytes each. The classes are balanced there, and the share of the classes
among all labelled rows outside the held-out fifth sets the intercept afterwards. Scoring reads whole texts.

Cases: a null text counts as empty, and an empty text is scored as one chunk of padding; equal texts have equal scores;
a null doc_id is not held out; a doc_id with several labels, or several rows, is an example once for each of them; without
labelled rows of both classes to train on the score is the share of label 1 among all labels (0.5 without any); an empty
table gives no rows; a very long text is scored whole, `BLOCK` chunks at a time, but a labelled one of more than
`SAMPLE_BYTES` bytes isn't trained on; other columns, whatever their names, are not read by `score_documents` and stay in
`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, table

FILTERS = 24
WIDTH = 6
CHUNK = 256
STRIDE = CHUNK - (WIDTH - 1)
SAMPLE = 2000
SAMPLE_BYTES = 65_536
EPOCHS = 14
BATCH = 32
RATE = 0.01
THRESHOLD = 0.3
FOLDS = 5
#: Chunks whose responses are in memory at once.
BLOCK = 256


class ByteNetwork:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.dense = np.zeros(2 * FILTERS, dtype=np.float32)
        self.intercept = np.zeros(1, dtype=np.float32)
        self.prior = 0.0

    @staticmethod
    def padded(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        chunks = max(1, -(-len(raw) // STRIDE))
        out = np.zeros(chunks * STRIDE + WIDTH - 1, dtype=np.uint8)
        out[: len(raw)] = raw
        return out

    def _responses(self, x: np.ndarray) -> np.ndarray:
        """Filter responses of whole chunks: (chunks, STRIDE, FILTERS)."""
        n = len(x) - (WIDTH - 1)
        out = self.filters[0].take(x[:n], axis=0)
        for j in range(1, WIDTH):
            out += self.filters[j].take(x[j : j + n], axis=0)
        return out.reshape(-1, STRIDE, FILTERS)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Rectified maximum of each filter in each chunk."""
        step = BLOCK * STRIDE
        parts = [self._responses(x[a : a + step + WIDTH - 1]).max(axis=1) for a in range(0, len(x) - (WIDTH - 1), step)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def score(self, text: str | None) -> float:
        m = self.pooled(self.padded(text))
        z = float(np.concatenate([m.max(axis=0), m.mean(axis=0)]) @ self.dense) + float(self.intercept[0]) + self.prior
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> ByteNetwork:
        """Adam on the logistic loss; the gradient of a maximum goes to its window alone."""
        rng = np.random.default_rng(seed)
        data = [self.padded(t) for t in texts]
        wanted = np.array(labels, dtype=np.float32)
        names = ("filters", "bias", "dense", "intercept")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for start in range(0, len(order), BATCH):
                grads = self._gradients([data[i] for i in order[start : start + BATCH]], wanted[order[start : start + BATCH]])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * getattr(self, k)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, batch: list[np.ndarray], wanted: np.ndarray) -> dict[str, np.ndarray]:
        grads = {"filters": np.zeros_like(self.filters), "bias": np.zeros_like(self.bias), "dense": np.zeros_like(self.dense), "intercept": np.zeros_like(self.intercept)}
        columns = np.arange(FILTERS)
        for x, y in zip(batch, wanted, strict=True):
            r = self._responses(x)
            at = r.argmax(axis=1)  # (chunks, FILTERS)
            raw = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :] + self.bias
            m = np.maximum(raw, 0)
            top = m.argmax(axis=0)
            features = np.concatenate([m[top, columns], m.mean(axis=0)])
            error = (1 / (1 + np.exp(-np.clip(features @ self.dense + self.intercept[0], -30, 30))) - y) / len(batch)
            grads["dense"] += error * features
            grads["intercept"] += error
            flow = np.repeat((error * self.dense[FILTERS:] / len(m))[None, :], len(m), axis=0)
            flow[top, columns] += error * self.dense[:FILTERS]
            flow *= raw > 0
            grads["bias"] += flow.sum(axis=0)
            place = np.arange(len(m))[:, None] * STRIDE + at
            for j in range(WIDTH):
                np.add.at(grads["filters"][j], (x[place + j], columns[None, :]), flow)
        return grads


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    """A network from a bounded sample of labelled rows outside the held-out fifth."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    network = ByteNetwork()
    both = sum(counts.values())
    share = counts.get(1, 0) / both if both else 0.5
    network.prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(counts) < 2:
        return network
    # Twice the rows that are wanted of each class: some may be too long or have no document.
    by_hash = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    chosen = F.broadcast(by_hash(0).union(by_hash(1)))  # 4 * sample rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = []
    for q in (0, 1):
        rows += texts.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text", "quality").collect()
    if len({r["quality"] for r in rows}) == 2:
        network.fit([r["text"] for r in rows], [r["quality"] for r in rows])
        ones = sum(r["quality"] for r in rows)
        network.prior = float(np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones)))
    return network


def _scores(network: ByteNetwork, texts: pa.Array) -> np.ndarray:
    return np.array([network.score(t) for t in texts.to_pylist()], dtype=np.float64)


def score_documents(docs: DataFrame, network: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array(_scores(network, batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, network: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the network accepts, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(network, batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))

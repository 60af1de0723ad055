import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import lm_corpus, lm_score, quality


def brute_scores(rows, targets, vocabulary, heavy):
    lists = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for ws in lists for w in ws)
    known = {w for w, n in counts.items() if n >= 2 and sum(m >= n for m in counts.values()) <= vocabulary}
    lists = [[w if w in known else None for w in ws] for ws in lists]
    size, models = len(known) + 1, []
    tokens = sum(map(len, lists))
    all_pairs = Counter(p for ws in lists for p in zip(ws, ws[1:], strict=False))
    kept = {p for p, n in all_pairs.items() if n >= max(1.0, heavy * tokens)}
    for chosen in (lists, [ws for ws, (d, _) in zip(lists, rows, strict=True) if d in targets]):
        words = Counter(w for ws in chosen for w in ws)
        pairs = Counter(p for ws in chosen for p in zip(ws, ws[1:], strict=False) if p in kept)
        models.append((words, pairs))

    def loss(model, ws):
        words, pairs = model
        total = 0.0
        for i, w in enumerate(ws):
            p = (words[w] + 1) / (sum(words.values()) + size)
            if i:
                share = {x: max(n - 0.5, 0) / max(words[ws[i - 1]], 1) for (v, x), n in pairs.items() if v == ws[i - 1]}
                p = p * (1 - sum(share.values())) + share.get(w, 0)
            total -= math.log(p)
        return total / len(ws)

    return [(d, (loss(models[1], ws) - loss(models[0], ws)) if ws else None) for (d, _), ws in zip(rows, lists, strict=True)]


@pytest.mark.parametrize("vocabulary,heavy", [(10**6, 0.0), (10**6, 0.05), (5, 0.05), (0, 0.0)])
def test_scores_are_brute_force(spark, vocabulary, heavy):
    rows = [(1, "a b a b c"), (2, "the cat the hat a b"), (3, None), (4, ""), (5, "A  b\tunknown words here and there the cat"), (6, "x" * 5000), (7, "a"), (8, "the cat sat the cat sat the cat")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (8, 0, 0), (5, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    models = lm_score.train(docs, labels, vocabulary, heavy)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs, models).collect()}
    for d, want in brute_scores(rows, {1, 2}, vocabulary, heavy):
        assert got[d] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_models_sum_to_one():
    rng = np.random.default_rng(0)
    words = [b"w%d" % i for i in range(9)]
    keys = np.sort(rng.choice(100, 30, replace=False))
    pairs = rng.integers(0, 6, (2, 30))
    models = lm_score.Models(words, rng.integers(5, 60, (2, 10)), keys, pairs)
    for m in range(2):
        for v in range(10):
            p = models.words[m] * models.backoff[m][v]
            for k, s in zip(models.keys, models.share[m], strict=True):
                if k // 10 == v:
                    p[k % 10] += s
            assert p.sum() == pytest.approx(1)


def test_limited_vocabulary_and_edges(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] % 2], "doc_id long, quality int, toxic int")
    models = lm_score.train(docs, labels, 50)
    assert 0 < len(models.ids) <= 50
    out = lm_score.score_documents(docs, models).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in out)


def sample(spark, n=240):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(20, 200)))
        good = i % 3 > 0
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((d, q) for d, q, _ in labels)


def test_classifier_separates_held_out_rows(spark):
    docs, labels, truth = sample(spark)
    out = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = sample(spark, 60)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert (a.filters == b.filters).all() and a.prior == b.prior


def test_every_window_counts_once():
    network = quality.ByteNetwork()
    text = "abc é" * 700
    x = network.padded(text)
    raw = text.encode()
    direct = np.array([sum(network.filters[j][raw[i + j] if i + j < len(raw) else 0] for j in range(quality.WIDTH)) for i in range(len(x) - quality.WIDTH + 1)])
    assert np.allclose(network.pooled(x).max(axis=0), np.maximum(direct.max(axis=0), 0), atol=1e-4)


def test_gradients_are_right():
    network = quality.ByteNetwork()
    rng = np.random.default_rng(0)
    network.dense[:] = rng.normal(size=network.dense.shape)
    data, y = [network.padded("some bytes %d" % i * 60) for i in range(3)], np.array([1, 0, 1], np.float32)

    def loss():
        total = 0.0
        for x, want in zip(data, y, strict=True):
            m = network.pooled(x)
            z = float(np.concatenate([m.max(axis=0), m.mean(axis=0)]) @ network.dense + network.intercept[0])
            total += math.log1p(math.exp(-z)) + (1 - want) * z
        return total / len(data)

    grads = network._gradients(data, y)
    for k, at in (("dense", (3,)), ("intercept", (0,)), ("bias", (2,)), ("filters", (1, ord("b"), 5))):
        values = getattr(network, k)
        old = values[at]
        values[at] = old + 1e-2
        up = loss()
        values[at] = old - 1e-2
        down = loss()
        values[at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-3, rel=0.05)


def test_edge_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    network = quality.train(docs, labels)
    out = quality.score_documents(docs, network).collect()
    assert len(out) == len(rows) and all(r["score"] == pytest.approx(0.5) for r in out)
    assert quality.keep_good(docs, network).columns == docs.columns
    assert quality.score_documents(empty, network).count() == 0
    models = lm_score.train(empty, labels)
    assert lm_score.score_documents(empty, models).count() == 0


def brute_whole(rows, targets):
    """Scores under models of every word and every bigram."""
    lists = [(t or "").encode().lower().split() for _, t in rows]
    size, models = len({w for ws in lists for w in ws}), []
    for chosen in (lists, [ws for ws, (d, _) in zip(lists, rows, strict=True) if d in targets]):
        models.append((Counter(w for ws in chosen for w in ws), Counter(p for ws in chosen for p in zip(ws, ws[1:], strict=False))))

    def loss(model, ws):
        words, pairs = model
        total = 0.0
        for i, w in enumerate(ws):
            p = (words[w] + 1) / (sum(words.values()) + size)
            if i:
                share = {x: (n - 0.5) / words[ws[i - 1]] for (v, x), n in pairs.items() if v == ws[i - 1]}
                p = p * (1 - sum(share.values())) + share.get(w, 0)
            total -= math.log(p)
        return total / len(ws)

    return Counter((d, None if not ws else round(loss(models[1], ws) - loss(models[0], ws), 8)) for (d, _), ws in zip(rows, lists, strict=True))


@pytest.mark.parametrize("chunk,bucket", [(lm_corpus.CHUNK, lm_corpus.BUCKET), (40, 25), (1, 7)])
def test_whole_models_are_brute_force(spark, chunk, bucket):
    rng = np.random.default_rng(6)
    words = ["the"] * 30 + [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(40)] + [(3, "the cat the hat A  b\ta B"), (3, "again w1 the w2"), (None, "no id w5 w6"), (50, None), (51, ""), (52, "x" * 5000)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0), (8, 0, 0), (5, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_corpus.score_corpus(docs, labels, chunk, bucket).collect()
    assert Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 8)) for r in got) == brute_whole(rows, {1, 2, 3})


def test_op4_models_grow_with_the_corpus(spark, tmp_path):
    """A pair of words that occurs twice in 4 million tokens, and words beyond 65,535, are in the models."""
    n = 70_000
    rows = [(i, f"a{i} b{i}", "en") for i in range(n)] * 2 + [(n + i, "und " * 40_000, "en") for i in range(100)] + [(n + 200, "b1 a1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = lm_score.op4_lm_scoring(spark, str(tmp_path))
    got = {r["doc_id"]: r["background_loss"] for r in out.where(F.col("doc_id").isin(1, n - 1, n + 200)).collect()}
    tokens, size = 4 * n + 4_000_000 + 2, 2 * n + 1
    assert got[n - 1] == pytest.approx(-(math.log(3 / (tokens + size)) + math.log(0.75 + 0.25 * 3 / (tokens + size))) / 2, abs=1e-9)
    assert got[n + 200] > got[1] + 0.3


def test_whole_models_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm_corpus.score_corpus(empty, labels).count() == 0


@pytest.mark.parametrize("text", [None, "", "a", "abc é" * 700, "x" * quality.STRIDE, "words of a text " * 40])
def test_classifier_scores_are_brute_force(text):
    """Every window one by one, pooled by chunk, and the logistic layer."""
    network = quality.ByteNetwork(3)
    rng = np.random.default_rng(1)
    network.dense[:], network.bias[:], network.intercept[:], network.prior = rng.normal(size=network.dense.shape), rng.normal(size=network.bias.shape), 0.3, -0.2
    raw = (text or "").encode()
    chunks = max(1, -(-len(raw) // quality.STRIDE))
    byte = lambda i: raw[i] if i < len(raw) else 0
    pooled = [np.maximum(np.max([sum(network.filters[j][byte(i + j)].astype(float) for j in range(quality.WIDTH)) for i in range(c * quality.STRIDE, (c + 1) * quality.STRIDE)], axis=0) + network.bias, 0) for c in range(chunks)]
    z = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)]) @ network.dense + 0.3 - 0.2
    assert network.score(text) == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-4)


def test_labels_of_an_id_count_each(spark):
    """A doc_id with two labels is an example under both; rows too long to train on leave the share of the labels."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(1, 30)], "doc_id long, text string")
    both = spark.createDataFrame([(i, q, 0) for i in range(1, 30) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, both).prior == pytest.approx(0, abs=1e-9)
    long = spark.createDataFrame([(i, "x" * 70_000) for i in range(1, 9)], "doc_id long, text string")
    some = spark.createDataFrame([(i, int(i > 2), 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    known = [i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5]
    share = sum(i > 2 for i in known) / len(known)
    assert quality.train(long, some).score("any") == pytest.approx(share, abs=1e-4)

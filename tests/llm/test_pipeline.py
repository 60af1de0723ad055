import re
from collections import Counter

import numpy as np
from test_native import WORD, brute_secrets
from test_near_dup import brute_groups

import corpus_pipeline as pipeline
from matchloom.llm import mixing, quality, tokens


def records(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_brute_force(spark, docs, rows, tmp_path):
    rng = np.random.default_rng(3)
    labels = [(r[0], int("!!" not in r[1] and "$" not in r[1]), 0) for r in rows if r[1] and r[0] is not None and rng.random() < 0.9]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["quality", "SimHash", "secret", "mixing", "best-fit"]
    kept = {"in": docs}
    network = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    current = docs
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, current, str(tmp_path)).cache()
        assert out.columns == docs.columns
        before, after = [tuple(r) for r in current.collect()], records(out)
        if name.startswith("quality"):
            assert after == Counter(r for r in before if network.score(r[1]) >= 0.3)
        elif name.startswith("SimHash"):
            assert Counter(r[0] for r in after.elements()) == Counter({c for _, _, c in brute_groups(before)})
            assert not after - Counter(before)
        elif name.startswith("secret"):
            assert sum(after.values()) == len(before)
            plain = Counter(r for r in before if not sum(brute_secrets(r[1])[:3]) and not re.search(r"[A-Za-z0-9+/_=-]{20}", r[1] or ""))
            assert not plain - after
            assert not any(sum(brute_secrets(r[1])[1:3]) for r in after)
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(current).collect()}
            assert after == Counter({r: copies[r[0]] for r in before if copies[r[0]]})
        current = out
    last = pipeline.STAGES[4][1](spark, current, str(tmp_path)).collect()
    codes = tokens.encoder(tokens.default_tokenizer())
    want = Counter()
    for r in current.collect():
        want[r["doc_id"]] += len(codes.encode([r["text"]])[0]) // 4 + 1
    got = Counter()
    for r in last:
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert len(WORD.findall("a b")) == 2 and kept


def test_rows_without_ids_reach_the_end(spark, tmp_path):
    """Unlike texts without doc_id pass near-dedup, secret scans and mixing one by one, and are packed."""
    import random

    from test_near_dup import unlike_rows

    rows, want = unlike_rows(random.Random(4))
    docs = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        if not name.startswith("mixing"):
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == want
    pieces = pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert pieces.where("piece = 0").count() == docs.count() == sum(want.values())


def test_stages_leave_no_tables_behind(spark, docs, tmp_path):
    from matchloom.llm import common

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(common.GIVEN)
    out = pipeline.run(spark, str(tmp_path))
    left = set(common.GIVEN) - before
    assert out.count() >= 0 and [p.rpartition("/")[2].split("-")[0] for p in left] == ["best"]


def test_run_gives_the_last_stage(spark, docs, tmp_path):
    docs.where("doc_id < 30").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_empty_corpus(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0

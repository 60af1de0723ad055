import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from matchloom.llm import lm_corpus, lm_score
from matchloom.llm.queries import SQL


def test_sql_gives_the_same_scores(spark, rows, tmp_path):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] % 3 > 0), int(r[0] % 7 == 0)) for r in rows if r[0] is not None] + [(2, 1, 0), (99_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = lm_score.op4_lm_scoring(spark, str(tmp_path))
    got = con.execute(SQL["op4_lm_scoring"])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want, found = got.fetchall(), [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert Counter((r[0], r[1]) for r in want) == Counter((r[0], r[1]) for r in found)
    for a, b in zip(sorted(want, key=key), sorted(found, key=key), strict=True):
        assert a[:2] == b[:2] and (set(a[2:]) == set(b[2:]) == {None} or a[2:] == pytest.approx(b[2:], abs=2e-9))


def brute_held_out(rows, targets):
    """Each row under models counted over all other rows; the vocabulary is that of all rows."""
    lists = [(t or "").encode().lower().split() for _, t in rows]
    size = len({w for ws in lists for w in ws})

    def loss(chosen, ws):
        words, pairs = Counter(w for x in chosen for w in x), Counter(p for x in chosen for p in zip(x, x[1:], strict=False))
        total = 0.0
        for i, w in enumerate(ws):
            p = (words[w] + 1) / (sum(words.values()) + size)
            if i:
                share = {x: (n - 0.5) / words[ws[i - 1]] for (v, x), n in pairs.items() if v == ws[i - 1]}
                p = p * (1 - sum(share.values())) + share.get(w, 0)
            total -= math.log(p)
        return total / len(ws)

    out = []
    for i, ((d, _), ws) in enumerate(zip(rows, lists, strict=True)):
        others = [x for j, x in enumerate(lists) if j != i]
        wanted = [x for j, (x, (e, _)) in enumerate(zip(lists, rows, strict=True)) if j != i and e in targets]
        out.append((d, None if not ws else round(loss(wanted, ws) - loss(others, ws), 7)))
    return Counter(out)


@pytest.mark.parametrize("chunk,bucket,own", [(1 << 20, 1 << 21, 1 << 17), (40, 25, 3), (1, 7, 1)])
def test_held_out_scores_are_brute_force(spark, monkeypatch, chunk, bucket, own):
    monkeypatch.setattr(lm_corpus, "OWN", own)
    rng = np.random.default_rng(9)
    words = ["the"] * 20 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(30)] + [(3, "the cat the hat A  b\ta B"), (40, "twice over the same words here"), (41, "twice over the same words here"), (None, "no id w5 w6"), (50, None), (51, ""), (52, "lone")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (40, 1, 0), (8, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_corpus.score_corpus(docs, labels, chunk, bucket, held_out=True).collect()
    assert Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 7)) for r in got) == brute_held_out(rows, {1, 2, 3, 40})

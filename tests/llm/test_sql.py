import random
import string
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.llm import mixing, rules, secrets
from matchloom.llm.sql import SQL


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def table(rows):
    """Rows with ids of their own, and random keys of several alphabets and lengths."""
    rng = random.Random(8)
    out = [(i, r[1], r[3]) for i, r in enumerate(rows)]
    for i in range(150):
        alphabet = rng.choice([string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase + "234567", string.digits + "abcdef", string.ascii_letters + string.digits + "+/", "ABCDEF0123456789"])
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.choice([19, 20, 21, 23, 33, 64]))) for _ in range(rng.randint(1, 4))]
        out.append((1000 + i, " und ".join(["word" * 7, *keys]) + "\nshared line of the letter 7", f"h{i % 3}"))
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, table, name):
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
    df = {
        "op8_secret_scans": lambda: secrets.scan(docs),
        "op9_quality_rules": lambda: rules.apply_rules(docs),
        "op10_mixing": lambda: mixing.mix(docs).select("doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"), "taken"),
    }[name]()
    con = duckdb.connect()
    frame = pd.DataFrame(table, columns=["doc_id", "text", "source"])
    con.register("documents", frame)
    con.execute("CREATE TABLE typed AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM documents")
    con.unregister("documents")
    con.execute("CREATE VIEW documents AS SELECT * FROM typed")
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert Counter(tuple(map(plain, r)) for r in got.fetchall()) == want

import math
import os
from collections import Counter

import duckdb
import pytest

from matchloom.plans import catalog, oracle

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings")


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 6)

    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_gives_the_rows_of_its_sql(spark, engine, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = engine.execute(oracle.SQL[name])
    assert bag(df.columns, df.collect()) == bag([d[0] for d in want.description], want.fetchall())

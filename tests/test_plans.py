import os

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, normalize, ranking
from matchloom.plans.catalog import QUERIES
from matchloom.plans.fixture import raw_records
from matchloom.schema import PAIR

RAW = "entity_id string, business_name string, business_address string, country string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "r.parquet")
    spark.createDataFrame([("S1-1", "Acme", "1 rd", "US")], RAW).write.parquet(path)
    df = normalize.normalize(spark.read.parquet(path))
    return df, normalize.targets(df.withColumn("entity_id", F.lit("S2-1")), df.limit(0))


def test_portable_normalization_stays_in_the_jvm(records):
    assert "Python" not in plan(records[0]) and "Python" in plan(normalize.normalize(records[0].select(*RAW.replace(" string", "").split(", ")), "full"))


def test_blocking_reads_only_what_it_needs(records):
    text = plan(blocking.pair_by_rare_key(*records, "name_compact", 100))
    assert "business_name" in text and "business_address" not in text.split("ReadSchema", 1)[1].split("\n")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_cuts_before_the_shuffle(spark):
    scored = spark.createDataFrame([("a", "x", 1.0)], f"{PAIR[0]} string, {PAIR[1]} string, score double")
    text = plan(ranking.top_k(scored, 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_ids_alone_travel_until_records_are_fetched(records):
    pairs = blocking.six_rules(*records)
    assert pairs.columns == list(PAIR)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_fixture_prunes_columns(spark):
    text = plan(raw_records(spark, "/root/testdata/sf0.001").select("entity_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_full_unicode_normalizes_all_sources(spark):
    got = QUERIES["normalize_full_unicode"](spark, "/root/testdata/sf0.001").groupBy(F.substring("entity_id", 1, 2).alias("of")).count().collect()
    assert {r["of"] for r in got} == {"S1", "S2", "S3"}

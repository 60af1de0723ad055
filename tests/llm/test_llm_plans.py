import re

import pytest

from matchloom.llm import mixing, near_dup, rules, secrets

ROWS = [(i, f"some words of text {i}\nand a line", "s") for i in range(20)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", [secrets.scan, secrets.redact, rules.apply_rules])
def test_native_operators_run_no_python(spark, op):
    text = plan(op(spark.createDataFrame(ROWS, "doc_id long, text string, source string")))
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_secret_scan_needs_no_shuffle(spark):
    assert "Exchange" not in plan(secrets.scan(spark.createDataFrame(ROWS, "doc_id long, text string, source string")))


def test_hot_groups_stay_whole(spark):
    """A third of all rows in one source, one text and one line."""
    rows = [(i, "one copied text of quite a few words in it" if i % 3 == 0 else f"own text number {i} with words a{i} b{i} c{i}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = near_dup.group(docs).collect()
    assert len(groups) == 900 and {r["component_id"] for r in groups if r["doc_id"] % 3 == 0} == {0}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 900
    hot = [r for r in mixed if r["pattern"] == ["hot"]]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"][0]) <= 10
    assert rules.apply_rules(docs).count() == 900

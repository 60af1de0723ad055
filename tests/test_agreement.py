"""Counts of candidates by groups of equal values against the pairs themselves."""

import random

import pytest

from matchloom.operators import agreement, blocking, evaluation
from matchloom.plans import catalog, flows, surface
from matchloom.schema import PAIR, LinkageError

DATA = "/root/testdata/sf0.001"
CONFIGS = {"plain": (2, 3, None), "rare": (2, 2, 9), "rarer": (1, 3, 5)}
CAP = 3
VALUES = "country string, name_compact string, address_compact string"


def _records(seed, repeated):
    """Rows of few values that agree in every way, some empty; with `repeated` some ids stand in several rows."""
    rng = random.Random(seed)
    texts = ["", *["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(12)]]

    def side(tag, n):
        ids = [f"{tag}-{i if not repeated or rng.random() > 0.3 else rng.randint(0, n)}" for i in range(n)]
        return [(i, rng.choice(["", "de", "fr"]), rng.choice(texts), rng.choice(texts)) for i in ids]

    left, right = side("S1", 40), side("S2", 60)
    left, right = left + left[:4], right + right[:6]
    groups = [[(i, rng.choice(["", "x", "y", None])) for i in dict.fromkeys(r[0] for r in rows)] for rows in (left, right)]
    return left, right, [g + (g[:3] if not repeated else [(i, "y") for i, _ in g[:5]]) for g in groups]


def _brute(left, right, groups, config, cap=CAP):
    """Of each entity the pairs of each table, and its true ones."""
    def frequency(column, size):
        return lambda v: sum(r[column][:size] == v[:size] for r in right if r[column])

    name, address, most = config
    three, prefix, true = set(), set(), {(s, t) for s, g in groups[0] for t, h in groups[1] if g is not None and g == h}
    for a in left:
        for b in right:
            same = [bool(a[k]) and a[k] == b[k] for k in (2, 3)]
            if all(same) or any(s and frequency(k, 99)(a[k]) <= cap for s, k in zip(same, (2, 3))):
                three.add((a[0], b[0]))
            if a[1] and a[1] == b[1] and any(a[k] and b[k] and a[k][:n] == b[k][:n] and (most is None or frequency(k, n)(a[k]) <= most) for k, n in ((2, name), (3, address))):
                prefix.add((a[0], b[0]))
    return {t: {i: (sum(s == i for s, _ in p), sum(s == i for s, _ in true), sum(s == i for s, _ in p & true)) for i, *_ in left} for t, p in zip(agreement.TABLES, (three, prefix, three | prefix))}


def _frames(spark, left, right, groups):
    s1, targets = spark.createDataFrame(left, f"entity_id string, {VALUES}"), spark.createDataFrame(right, f"{PAIR[1]} string, {VALUES}")
    entities = spark.createDataFrame(groups[0], f"{PAIR[0]} string, group string")
    return s1, targets, evaluation.Groups(entities, spark.createDataFrame([(g, i) for i, g in groups[1]], f"group string, {PAIR[1]} string"))


@pytest.mark.parametrize("repeated", [False, True])
def test_counts_are_those_of_the_pairs(spark, repeated):
    left, right, groups = _records(5 + repeated, repeated)
    got = {}
    for r in agreement.prefix_counts(*_frames(spark, left, right, groups), CONFIGS, CAP).collect():
        assert got.setdefault((r["config"], r["table"]), {}).setdefault(r[PAIR[0]], (r["n"], r["n_true"], r["n_found"])) == (r["n"], r["n_true"], r["n_found"])
    for name, config in CONFIGS.items():
        for table, want in _brute(left, right, groups, config).items():
            assert got[name, table] == want and any(n for n, _, _ in want.values()), (name, table)


def test_the_limit_of_a_report_by_groups(spark, monkeypatch):
    frames = _frames(spark, *_records(7, False))
    monkeypatch.setattr(blocking, "SELECTIVE", CONFIGS)
    whole = {r["name"]: r.asDict() for r in flows.selective_report(*frames, None, max_candidates=None).collect()}
    limit = sorted(r["n_prefix"] for r in whole.values())[1]
    for r in flows.selective_report(*frames, None, max_candidates=limit).collect():
        want = whole[r["name"]]
        assert r.asDict() == want if want["n_prefix"] <= limit else (r["n_prefix"] == want["n_prefix"] and r["n_pairs"] is None)
    with pytest.raises(LinkageError):
        flows.selective_report(*frames, None, max_candidates=-1)
    with pytest.raises(LinkageError):
        flows.selective_report(*frames, blocking.three_rules(*frames[:2]))


@pytest.mark.parametrize("query", [catalog.QUERIES["prefix_comparison"], surface.QUERIES["selective_report"]])
def test_no_pairs_are_made(spark, monkeypatch, query):
    for module, made in ((blocking, "prefix_pairs"), (blocking, "three_rules"), (evaluation, "truth_pairs")):
        monkeypatch.setattr(module, made, lambda *args, **options: pytest.fail("pairs"))
    assert query(spark, DATA).count()

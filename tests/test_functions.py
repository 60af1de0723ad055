import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import arrays, scorers, text

WORDS = st.text(alphabet="abcde é", max_size=14)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "mode,raw,want",
    [("portable", "  Foo-Bar   & Co., Ltd. ", "foo-bar co ltd"), ("portable", "O'Neil_Söhne Straße", "o'neil_söhne strasse"), ("full", "Ｃａｆé ﬁne ẞ", "café fine ss"), ("portable", None, ""), ("portable", "", ""), ("full", None, ""), ("portable", "\t A\n\nB ", "a b")],
)
def test_names(spark, mode, raw, want):
    assert values(spark, [(raw,)], "x string", text.normalize_name(F.col("x"), mode)) == [(want,)]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        text.normalize_name(F.lit("x"), "other")


def test_addresses_tokens_and_numbers(spark):
    rows = [("21, Main Rd. Strd st",), ("Blvd 1.5 ln-2 ave",), (None,)]
    norm = text.normalize_address(F.col("x"))
    got = values(spark, rows, "x string", norm, text.compact(norm), text.tokens(norm), text.numbers(norm), text.numbers(F.col("x")))
    assert got[0] == ("21 main road strd street", "21mainroadstrdstreet", ["21", "main", "road", "strd", "street"], ["21"], ["21"])
    assert got[1][0] == "boulevard 1 5 ln-2 avenue" and got[1][2] == ["boulevard", "1", "5", "ln-2", "avenue"] and got[1][4] == ["1.5", "2"]
    assert got[2][:4] == ("", "", [], [])


def test_sets(spark):
    rows = [(["a", "b", "b"], ["b", "c"]), ([], []), (None, ["a"]), (["a"], None)]
    got = values(spark, rows, "a array<string>, b array<string>", arrays.jaccard(F.col("a"), F.col("b")), arrays.jaccard(F.col("a"), F.col("b"), 1.0), arrays.shares(F.col("a"), F.col("b")), arrays.overlap(F.col("a"), F.col("b")))
    assert got == [(pytest.approx(1 / 3), pytest.approx(1 / 3), True, 1), (0.0, 1.0, False, 0), (0.0, 0.0, False, 0), (0.0, 0.0, False, 0)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_scorers_hold_their_laws(a, b):
    assert scorers.lcs(a, b) == plain_lcs(a, b)
    for name, f in scorers._BY_NAME.items():
        assert 0 <= f(a, b) <= 1
        assert f(a, b) == pytest.approx(f(b, a)), name
    assert scorers.ratio(a, a) == scorers.partial_ratio(a, a) == scorers.token_sort_ratio(a, a) == 1
    if a and len(b) >= len(a):
        windows = [b[max(0, e - len(a)) : e] for e in range(1, len(b) + len(a))]
        assert scorers.partial_ratio(a, b) == pytest.approx(max(scorers.ratio(a, w) for w in windows)) or len(a) == len(b)


def test_known_scores():
    assert scorers.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert scorers.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert scorers.ratio("this is a test", "this is a test!") == pytest.approx(0.965517, abs=1e-6)
    assert scorers.partial_ratio("test", "this is a test!") == 1
    assert scorers.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert scorers.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert scorers.token_set_ratio("", "a") == 0 and scorers.ratio("", "") == 1 and scorers.ratio("", "a") == 0


def test_udf_and_native_lcs_agree(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))) for _ in range(40)] + [("", "a"), (None, "b")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", scorers.score(F.col("a"), F.col("b")).alias("s"), scorers.native_lcs(F.coalesce("a", F.lit("")), F.col("b")).alias("n")).collect()
    for r in got:
        a, b = r["a"] or "", r["b"]
        assert r["n"] == scorers.lcs(a, b)
        assert [r["s"][n] for n in scorers.SCORERS] == pytest.approx([scorers._BY_NAME[n](a, b) for n in scorers.SCORERS])


def test_windows_in_numpy_are_those_of_one_pair():
    import random

    rng = random.Random(4)

    def text():
        return " ".join("".join(rng.choice("abcdeüé\U0001f600") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 7)))

    pairs = [(text(), text()) for _ in range(400)]
    pairs += [(a, a[::-1]) for a, _ in pairs[:60]] + [("x" * 70, "y" * 3 + "x" * 80), ("a" * 62, "b" * 62), ("a" * 62, "c" + "a" * 61), ("", ""), ("a", ""), ("a\0b", "a\0bc\0")]
    assert scorers.partial_ratios(pairs).tolist() == [scorers.partial_ratio(a, b) for a, b in pairs]
    assert scorers.partial_ratios([]).tolist() == []


def test_scores_of_many_pairs_are_those_of_one(monkeypatch):
    rng = random.Random(7)

    def some(letters, words, size):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(rng.randint(0, words)))

    pairs = [(some("abcdeüé\U0001f600", 7, 8), some("abcdeüé\U0001f600", 7, 8)) for _ in range(300)] + [(some("ab", 5, 3), some("ab", 5, 3)) for _ in range(300)]
    pairs += [(" ".join(rng.sample(a.split(), len(a.split()))), b) for a, b in pairs[:200]] + [(a, a[::-1]) for a, _ in pairs[:60]]
    pairs += [("", ""), ("a", ""), ("", "b"), (" ", "a"), ("a\0b", "a\0bc\0"), ("a" * 62, "c" + "a" * 61), ("ab" * 40, "a b" * 40), ("abc", "x" * 5000 + "abd"), ("\ud800a", "a\ud800"), ("a  b c", " c b ")]
    for cells in (scorers.CELLS, 500):  # in runs of all pairs, and of few
        monkeypatch.setattr(scorers, "CELLS", cells)
        for name, one in scorers._BY_NAME.items():
            assert scorers._OF_MANY[name](pairs).tolist() == [one(a, b) for a, b in pairs], name
            assert scorers._OF_MANY[name]([]).tolist() == []

import hashlib
import random
import re
import string
import time
from collections import Counter

import pytest

from matchloom.llm import mixing, rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def brute_secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *[sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(spans.encode()).hexdigest()


def test_secret_base_is_brute_force(docs, rows):
    got = bag(secrets.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == Counter((r[0], *brute_secrets(r[1])) for r in rows)


def test_random_keys_are_found_and_prose_is_not(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(50)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)]
    plain = ["thestreontheonerthandstre internationalization_of_the_registration", "z" * 50 + " ----------------------------", "Donaudampfschifffahrtsgesellschaft", "KLMN" * 10, "short kJ8vQ2mZx0Lr7"]
    rows += [(100 + i, t) for i, t in enumerate(plain)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:4:44" for i in range(50)) >= 45
    assert not any(got[100 + i] for i in range(len(plain)))


@pytest.mark.parametrize("extra,pad", [("+/", ""), ("+/", "=="), ("-_", ""), ("-_", "=")])
def test_long_base64_keys_are_found(spark, extra, pad):
    rng = random.Random(11)
    alphabet = string.ascii_letters + string.digits + extra
    rows = [(i, "see " + "".join(rng.choice(alphabet) for _ in range((500, 800, 1024, 2048, 4000)[i % 5])) + pad + " here") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(5):
        assert sum(got[i] == f"random:4:{len(rows[i][1]) - 5}" for i in range(k, 100, 5)) >= 18


def test_redaction_takes_all_spans_and_keeps_the_rest(docs, rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert not [r for r in secrets.scan(out).collect() if r["n_access"] or r["n_hex"]]
    got = {r["doc_id"]: r for r in out.collect()}
    for r in rows:
        if sum(brute_secrets(r[1])[:3]) == 0 and r[0] not in (5, None) and "kJ8v" not in (r[1] or ""):
            assert got[r[0]]["text"] == r[1]


def test_many_matches_take_linear_time(spark):
    """32,000 access keys in a text: an array that grows by appending took 99 seconds for them."""
    rng = random.Random(3)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(16)) for _ in range(32_000)]
    text = " ".join(keys)
    docs = spark.createDataFrame([(1, text, len(text)), (2, "none here", 9)], "doc_id long, text string, n_chars long")
    secrets.scan(docs.where("doc_id = 2")).collect()
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.perf_counter() - began < 20
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"], got[1]["base_sha256"]) == brute_secrets(text)
    assert clean == {1: " ".join(["[secret]"] * 32_000), 2: "none here"}


def test_masks_join_what_overlaps(spark):
    """Spans of several kinds that overlap, blocks that a span crosses, and text behind the last span."""
    hidden = "0123456789abcdef" * 3
    texts = [f"password={hidden} end", "x" * 4090 + " token: AKIA" + "Q" * 30 + " \U0001f600 " + "y" * 9000 + " " + hidden, hidden, f"{hidden} {hidden}", "AKIA" + "A" * 5000 + "z"]
    got = [r["text"] for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["[secret] end", "x" * 4090 + " [secret] \U0001f600 " + "y" * 9000 + " [secret]", "[secret]", "[secret] [secret]", "[secret]z"]


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_rules_are_brute_force(docs, rows):
    out = rules.apply_rules(docs)
    got = bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((r[0], *brute_rules(r[1])) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in out.collect())


def test_boilerplate_is_counted_per_host_and_depletes(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = lambda i: " ".join(f"{letters[i % 26]}{letters[i // 26]}{letters[j % 26]}{letters[j // 26]}" for j in range(60))
    common = "Subscribe to our letter 12 " + " ".join(f"c{j}" for j in range(50))
    rows = [(i, "h", common.replace("12", str(i)) + "\n" + body(i)) for i in range(30)] + [(100, "h", common + "\n" + "few words"), (101, "g", common + "\n" + "few words"), (102, "h", body(7))]
    rows += [(200 + i, "copies", "one text that many copies have " + body(1)) for i in range(50)]
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not got[100]["kept"] and got[101]["kept"] and got[102]["kept"]
    assert all(got[i]["kept"] and got[i]["boilerplate_share"] > 0 for i in range(30))
    assert all(got[200 + i]["kept"] for i in range(50))


def test_texts_without_boilerplate(spark):
    rows = [(i, "h", f"Shared line {i}\n\nbody of {chr(97 + i)}\n  shared  LINE 7 ", 1.5) for i in range(26)] + [(90, "g", "Shared line 1", 2.5), (None, "h", "Shared line 9", None), (91, "h", None, 0.0), (92, None, "", 0.0)]
    out = rules.without_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string, score double"))
    assert out.columns == ["doc_id", "source", "text", "score"]
    want = [(i, "h", f"\nbody of {chr(97 + i)}", 1.5) for i in range(26)] + [(90, "g", "Shared line 1", 2.5), (None, "h", "", None), (91, "h", None, 0.0), (92, None, "", 0.0)]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_rows_without_ids_are_mixed_one_by_one(spark):
    """Half of all ids null, and some rows that share an id: each source ends within a document of its target."""
    rng = random.Random(12)
    rows = [(None if i % 2 else 7 if i % 10 == 0 else i, " ".join(f"w{i}x{j}" for j in range(rng.randint(1, 12))), f"s{i % 3}") for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(out) == 600
    for s in ("s0", "s1", "s2"):
        mine = [r for r in out if r["pattern"] == [s]]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"][0]) <= 12
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(2)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in out) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)


def test_copies_name_all_sources_of_a_text(spark):
    from pyspark.sql import functions as F

    rows = [(1, "one text", "b"), (2, "one text", "a"), (3, "one text", "a"), (4, "two", None), (5, "two", "a"), (6, None, "b"), (7, "", "c")]
    held = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"]: r["held_by"] for r in held.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"], 4: ["a", None], 5: ["a", None], 6: ["b", "c"], 7: ["b", "c"]}
    out = mixing.mix(held, memberships=F.col("held_by")).collect()
    assert {r["doc_id"]: r["pattern"] for r in out} == {r["doc_id"]: r["held_by"] for r in held.collect()}


def brute_cost(capacity, wanted, most):
    """Words sent and their least cost, over all ways to send whole words."""
    arcs = [(p, s) for p in capacity for s in p]
    best = (0, 0)

    def go(i, sent, left):
        nonlocal best
        if i == len(arcs):
            cost = sum(min(max(sent[p] - (r - 1) * n, 0), n) * r * r for p, n in capacity.items() for r in range(1, most + 1))
            best = min(best, (-sum(sent.values()), cost))
            return
        p, s = arcs[i]
        for x in range(min(left[s], most * capacity[p] - sent[p]) + 1):
            go(i + 1, sent | {p: sent[p] + x}, left | {s: left[s] - x})

    go(0, dict.fromkeys(capacity, 0), dict(wanted))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flow_has_the_least_cost(seed):
    rng = random.Random(seed)
    capacity = {p: rng.randint(1, 3) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
    wanted = {s: rng.randint(1, 5) for s in sorted({s for p in capacity for s in p})}
    sent = {p: sum(v.values()) for p, v in mixing.flow(capacity, wanted, 3).items()}
    cost = sum(min(max(sent[p] - (r - 1) * n, 0), n) * r * r for p, n in capacity.items() for r in (1, 2, 3))
    assert (-sum(sent.values()), cost) == pytest.approx(brute_cost(capacity, wanted, 3))


def test_mix_meets_its_targets(docs, rows):
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()) == Counter((r["doc_id"], r["taken"]) for r in out)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets(dict(sizes), order)
    for s in order:
        mine = [r for r in out if r["pattern"] == [s]]
        assert {r["source_size"][0] for r in mine} == {sizes[s]}
        assert {r["target"][0] for r in mine} == {want[s]}
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_targets_stop_at_three_times_and_share_the_rest():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1}, ["a", "b", "c"])
    assert got == {"a": 30.0, "b": 978.0, "c": 3.0}
    assert mixing.targets({"a": 0}, ["a"]) == {"a": 0.0}


def test_flow_uses_overlap_and_spreads_repetitions():
    sent = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 1}, {"a": 12, "b": 12})
    assert sum(v.get("a", 0) for v in sent.values()) == pytest.approx(12)
    assert sum(v.get("b", 0) for v in sent.values()) == pytest.approx(12)
    total = {p: sum(v.values()) for p, v in sent.items()}
    assert total["a",] <= 20 and total["b",] <= 3 and total["a", "b"] <= 20


def test_memberships_may_overlap(spark):
    from pyspark.sql import functions as F

    rows = [(i, "one two three", ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, held array<string>"), memberships=F.col("held")).collect()
    assert len(out) == 100 and sum(r["taken"] for r in out) == pytest.approx(450, abs=6)


@pytest.mark.parametrize("op", [secrets.scan, secrets.redact, rules.apply_rules, mixing.mix])
def test_empty_table(empty, op):
    assert op(empty).count() == 0

import random
import re
from collections import Counter

import pytest
import xxhash

from matchloom.llm import near_dup
from matchloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))


def test_groups_are_brute_force(docs, rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_dup.group(docs).collect())
    assert got == brute_groups(rows)


def test_near_copies_link(spark):
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(500)]
    rows = []
    for g in range(6):
        words = [rng.choice(vocabulary) for _ in range(800)]
        for k in range(8):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(800)] = rng.choice(vocabulary)
            rows.append((10 * g + k, " ".join(copy)))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_dup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_groups(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_links_find_all_pairs_in_the_radius(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = set(seeds)
    for s in seeds:
        for _ in range(40):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = near_dup.links(spark.createDataFrame(signed, "fp long"))
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    values = [v for (v,) in signed]
    root = {v: found.get(v, v) for v in values}
    want = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and want[b] < want[a]:
                    want[a], changed = want[b], True
    assert root == want


@pytest.mark.parametrize("kind", ["path", "star", "loops"])
def test_components(spark, kind):
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(200)], "loops": [(1, 1), (2, 3), (3, 2), (3, 2)]}[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {"path": {i: 0 for i in range(1, 201)}, "star": {i: 0 for i in [*range(1, 200), 500]}, "loops": {3: 2}}[kind]


def test_one_of_each_group_stays(docs, rows):
    out = near_dup.keep_one(docs)
    assert out.columns == docs.columns
    groups = {c for _, _, c in brute_groups(rows)}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(groups)


def test_unlike_rows_without_ids_stay(spark):
    texts = [f"first{i} second{i} third{i} fourth{i}" for i in range(6)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (1, texts[1]), (2, "a text of its own")]
    out = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in out) == Counter([(None, t) for t in [texts[0], *texts[2:]]] + [(1, texts[1]), (2, "a text of its own")])


def unlike_rows(rng, start=0):
    """20 unlike texts with ids; 50 rows without: 20 more unlike texts, twice each, and copies of 10 of the first."""
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(90))
    known, lone = [text() for _ in range(20)], [text() for _ in range(20)]
    rows = [(start + i, t) for i, t in enumerate(known)] + [(None, t) for t in lone + lone + known[:10]]
    return rows, Counter([(start + i, t) for i, t in enumerate(known)] + [(None, t) for t in lone])


def test_no_text_without_id_is_lost(spark):
    rows, want = unlike_rows(random.Random(2))
    out = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, out)) == want


def test_intermediate_tables_go(spark):
    from matchloom.llm import common

    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    before = set(common.GIVEN)
    with common.scratch(spark) as kept:
        frame, path = common.staged(components(edges), "kept")
        kept.add(path)
    assert set(common.GIVEN) - before == {path} and frame.count() == 30
    common.discard(spark, [path])
    assert set(common.GIVEN) == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from matchloom.llm import common

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(sparkContext=context))


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from matchloom.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (10 if i else 5000) for i in range(100)])], names=["t"])
    parts = list(slices(iter([batch]), 30, 1000))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows <= 30 and (p.nbytes <= 1000 or p.num_rows == 1) for p in parts)


def test_empty_table(empty):
    assert near_dup.group(empty).count() == 0 and near_dup.keep_one(empty).count() == 0

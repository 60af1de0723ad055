import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm import packing, tokens, wavelet


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["it's we'll 'tis x's.'s !'s rock'n'roll", "a b c\x85d\x1ce", "H̱ ẖ Á École É ﬁ ǅ İ ΣΣ σΣ.", "12.5% 3rd 2nd x2y ½ ² ำ", "<|endoftext|>a <|startoftext|> <|endoftext|><|endoftext|> <| |> b<|", "ſ K Å ß ẞ straße STRASSE", "\r\n\t x\ty \n\n z ", "日本語 テスト 한국어 🙂🙂 👩‍👩‍👧", "don't!! !!don't can't've ''' 's", "a" * 5000, "퟿ ̀́ à ‍"]


@pytest.mark.parametrize("cache", [0, 5, 10**6])
def test_words_give_the_library_s_ids(library, rows, cache):
    texts = [r[1] for r in rows] + ODD
    codes = tokens.WordEncoder(tokens.default_tokenizer(), cache)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in codes.encode(texts)] == [plain(library, t) for t in texts]


@pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (7, 3), (1024, 50), (5000, 49408), (3000, 70000)])
def test_wavelet_matrix_answers_like_a_list(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    shard = wavelet.Shard.from_bytes(wavelet.Shard([None, 4], np.array([0, n]), wavelet.WaveletMatrix.build(ids)).to_bytes())
    m, values = shard.matrix, ids.tolist()
    assert shard.doc_ids == [None, 4] and shard.lengths.tolist() == [0, n]
    assert m.tokens().tolist() == values
    for i in range(0, n, 97):
        assert m.access(i) == values[i]
        assert m.rank(values[i], i) == values[:i].count(values[i])
        assert m.select(values[i], values[:i].count(values[i])) == i
        assert m.count(values[i]) == values.count(values[i])
    assert m.count(1 << 20) == 0 and m.occurrences(high + 1) == []
    if n:
        assert m.occurrences(values[0]) == [i for i, v in enumerate(values) if v == values[0]]
        with pytest.raises(IndexError):
            m.select(values[0], n)


@pytest.mark.parametrize("n,high", [(0, 2), (1, 9), (70_000, 3), (300_000, 40_000)])
def test_a_token_costs_a_segment_a_level(n, high, tmp_path):
    ids = np.random.default_rng(n).integers(0, high, n)
    data = wavelet.Shard([7], np.array([n]), wavelet.WaveletMatrix.build(ids)).to_bytes()
    reads = []

    def read(start, size):
        reads.append(size)
        return data[start : start + size]

    lazy = wavelet.Shard.open(read)
    reads.clear()
    for i in range(0, n, max(1, n // 5)):
        assert lazy.matrix.access(i) == ids[i]
        assert len(reads) <= 2 * lazy.matrix.levels and max(reads, default=0) <= wavelet.SEGMENT + 64
        reads.clear()
    if n:
        token = int(ids[n // 2])
        assert lazy.matrix.count(token) == int((ids == token).sum())
        assert lazy.matrix.select(token, 0) == int(np.flatnonzero(ids == token)[0])
        (tmp_path / "s.wvm").write_bytes(data)
        assert wavelet.open_shard(f"file://{tmp_path}/s.wvm").matrix.access(n - 1) == ids[-1]
    assert wavelet.Shard.from_bytes(data).matrix.tokens().tolist() == ids.tolist()


@pytest.mark.parametrize("shard_tokens", [1, 500, 1 << 20])
def test_shards_round_trip(spark, library, docs, rows, shard_tokens):
    manifest = wavelet.write_shards(docs, wavelet._folder(spark), tokens.default_tokenizer(), 1, shard_tokens)
    got = wavelet.read_shards(manifest).collect()
    want = Counter((r[0], len(ids := [*plain(library, r[1]), 1]), crc(ids)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_packing_is_gapless_and_whole(spark, library, docs, rows):
    got = packing.pack(docs).collect()
    want = Counter()
    for r in rows:
        ids = [*plain(library, r[1]), 0]
        want.update((r[0], i, at, len(p := ids[at : at + 2048]), crc(p)) for i, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_program_is_near_the_bound():
    rng = np.random.default_rng(3)
    for n in (10, 500, 40_000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int) + 1, 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        solution = packing.solve(counts)
        held = np.zeros(2049, dtype=int)
        for config, times in solution:
            assert sum(a * b for a, b in config) <= 2048
            for length, copies in config:
                held[length] += copies * times
        assert (held == counts).all()
        assert sum(times for _, times in solution) <= -(-int(lengths.sum()) // 2048) * 1.01 + 1


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_packing_comes_within_the_gap_of_the_bound(n):
    """Text-like lengths: no packing needs fewer sequences than the tokens fill, and the program exceeds that by GAP at most."""
    lengths = np.clip(np.random.default_rng(8).lognormal(6, 1, n).astype(int) + 1, 1, 2048)
    used = sum(times for _, times in packing.solve(np.bincount(lengths, minlength=2049)))
    least = -(-int(lengths.sum()) // 2048)
    assert least <= used <= least * (1 + packing.GAP) + 1


def test_closing_holds_every_piece():
    rng = np.random.default_rng(5)
    for n in (1, 7, 400):
        left = np.bincount(rng.integers(1, 65, n), minlength=65)
        held = np.zeros(65, dtype=int)
        for config, times in packing.close(left, 64):
            assert times > 0 and sum(a * b for a, b in config) <= 64
            for length, copies in config:
                held[length] += copies * times
        assert (held == left).all()
    assert packing.close(np.zeros(65, dtype=int), 64) == []


def test_small_instances_are_optimal():
    def fewest(lengths, capacity):
        best = len(lengths)

        def go(i, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if i == len(lengths):
                best = len(loads)
                return
            for k in range(len(loads)):
                if loads[k] + lengths[i] <= capacity:
                    go(i + 1, [*loads[:k], loads[k] + lengths[i], *loads[k + 1 :]])
            go(i + 1, [*loads, lengths[i]])

        go(0, [])
        return best

    rng = random.Random(2)
    worse = 0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 12) for _ in range(9)), reverse=True)
        got = sum(n for _, n in packing.solve(np.bincount(lengths, minlength=13), 12))
        worse += got - fewest(lengths, 12)
    assert worse <= 4


@pytest.mark.parametrize("case", ["pack", "shards"])
def test_empty_table(spark, empty, case):
    out = packing.pack(empty) if case == "pack" else wavelet.read_shards(wavelet.write_shards(empty, wavelet._folder(spark), tokens.default_tokenizer(), 1))
    assert out.count() == 0

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import license_scan, media

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_is_brute_force(docs, rows):
    got = license_scan.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r[0], *brute_scan(r[1])) for r in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"]) or r["labels"] == "spdx-invalid"


def test_adjacent_and_overlapping_places(spark):
    texts = ["mit license mit license", "GNU Lesser General Public License; affero general-public license", "permit license", "mit  LICENSE\nx apache license general public license mit license", "SPDX-License-Identifier: MIT AND"]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(text)
    assert got[1]["labels"] == "agpl,gpl,lgpl" and "spdx-invalid" in got[4]["labels"]


@pytest.mark.parametrize(
    "text,want",
    [("MIT", (["mit"], 0)), ("MIT OR GPL-3.0-only", (["mit", "gpl-3.0-only"], 0)), ("MIT AND GPL-3.0-only", (["mit", "gpl-3.0-only"], 2)), ("GPL-2.0-only WITH Classpath-exception-2.0", (["gpl-2.0-only"], 1)), ("MIT OR Apache-2.0 AND GPL-2.0+", (["mit", "apache-2.0", "gpl-2.0+"], 0)), ("(MIT OR Apache-2.0) AND LGPL-2.1", (["mit", "apache-2.0", "lgpl-2.1"], 1)), ("Proprietary", (["proprietary"], 3))],
)
def test_expressions(text, want):
    assert license_scan.evaluate(text) == want


@pytest.mark.parametrize("text", ["", "AND", "MIT AND", "(MIT", "MIT)", "MIT GPL", "()", "WITH x", "MIT (GPL)"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        license_scan.evaluate(text)


def brute_expression(text):
    """Ids, strength and whether it breaks off, by recursive descent over the longest list of tokens that parses."""
    tokens, spot = [], 0
    while m := re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)").match(text, spot):
        tokens.append(m[1].rstrip(".-") or m[1])
        spot = m.end()
        if m[1] not in "()" and m[1][-1] in ".-":
            break

    def strict(tokens):
        rest, ids = list(tokens), []

        def atom():
            t = rest.pop(0)
            if t == "(":
                value = either()
                assert rest.pop(0) == ")"
                return value
            assert t not in ("and", "or", "with", ")")
            ids.append(t)
            return license_scan.strength(t)

        def exception():
            value = atom()
            while rest and rest[0] == "with":
                rest.pop(0)
                n = len(ids)
                atom()
                del ids[n:]
                value -= value in (1, 2)
            return value

        def both():
            value = exception()
            while rest and rest[0] == "and":
                rest.pop(0)
                value = max(value, exception())
            return value

        def either():
            value = both()
            while rest and rest[0] == "or":
                rest.pop(0)
                value = min(value, both())
            return value

        value = either()
        assert not rest
        return ids, value

    for n in range(len(tokens), 0, -1):
        try:
            found = strict(tokens[:n])
        except (AssertionError, IndexError):
            continue
        following = tokens[n] if n < len(tokens) else ""
        if n == 1 and following and following not in ("and", "or", "with", "(", ")") and found[1] == 3 and "-" not in tokens[0]:
            return [], None, True
        return *found, following in ("and", "or", "with", "(", ")") and following != ""
    return [], None, True


PHRASE_WORDS = {p: p.split() for p in (*license_scan.BASE, *license_scan.PHRASES)}


def brute_labels(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    spans = [m.span() for m in WORD.finditer(lowered)]
    words = [lowered[a:b] for a, b in spans]
    labels, doubt = set(), 1.0
    for phrase, p in PHRASE_WORDS.items():
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            label, confidence = license_scan.PHRASES.get(phrase, (license_scan.BASE.get(phrase), license_scan.BASE_CONFIDENCE))
            labels.add(label)
            doubt *= 1 - confidence
    for i in range(len(words)):
        if words[i : i + 3] == ["spdx", "license", "identifier"]:
            ids, level, broken = brute_expression(re.sub(r"^[ \t]*:?", "", lowered[spans[i + 2][1] :]))
            labels |= {f"spdx:{x}" for x in ids} | ({"spdx-invalid"} if broken else set())
            if level is not None:
                labels.add(f"spdx-{license_scan.STRENGTHS[level]}")
                doubt *= 1 - license_scan.TAG_CONFIDENCE
    return ",".join(sorted(labels)), round(1 - doubt, 9)


TAGGED = [
    "SPDX-License-Identifier: MIT. See LICENSE file.",
    "SPDX License Identifier: MIT",
    "spdx-license-identifier MIT OR (Apache-2.0 AND GPL-2.0+) and more words",
    "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */\nint main",
    "SPDX-License-Identifier: see LICENSE",
    "SPDX-License-Identifier: Proprietary\nSPDX-License-Identifier: LGPL-2.1 (or later)",
    "SPDX-License-Identifier: (MIT OR",
    "SPDX-License-Identifier:\nMIT",
    "SPDX-License-Identifier: MIT) and MIT",
    "the SPDX license identifier. SPDX-License-Identifier: WITH x",
    "É SPDX-License-Identifier:\tBSD-3-Clause, mit license, all rights reserved",
    "SPDX-License-Identifier: MIT AND AND MIT",
    "SPDX-License-Identifier: " + "(" * 3000 + "MIT" + ")" * 3000,
    "SPDX-License-Identifier: " + "MIT OR " * 3000 + "x",
]


def test_labels_and_score_are_brute_force(spark, rows):
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(30_000)
    texts = [*TAGGED[:-2], *(r[1] for r in rows)]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: brute_labels(t) for i, t in enumerate(texts)}
    sys.setrecursionlimit(before)
    assert got == want
    assert got[0] == ("spdx-permissive,spdx:mit", 0.9) == got[1]


def test_long_expressions_are_read_whole():
    machine = license_scan.automaton()
    assert license_scan.scan_text(machine, TAGGED[-2])[5:] == ("spdx-permissive,spdx:mit", pytest.approx(0.9))
    assert license_scan.scan_text(machine, TAGGED[-1])[5] == "spdx-permissive,spdx:mit,spdx:x"


def area_mean(pixels, height, width):
    out = np.zeros((height, width))
    h, w = pixels.shape
    for i in range(height):
        for j in range(width):
            top, low, left, right = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = sum(pixels[y, x] * (min(y + 1, low) - max(y, top)) * (min(x + 1, right) - max(x, left)) for y in range(int(top), min(h, int(np.ceil(low)))) for x in range(int(left), min(w, int(np.ceil(right)))))
            out[i, j] = total / ((low - top) * (right - left))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (24, 24), (3, 50)])
def test_resize_is_the_area_mean(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(media.resize(pixels, 4, 6), area_mean(pixels.astype(float), 4, 6))


def test_formats_round_trip():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (5, 7), (8, 4)):
        grey, colour = rng.integers(0, 256, (h, w)).astype(np.uint8), rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (media.decode(media.encode_netpbm(grey)) == grey).all()
        assert (media.decode(media.encode_netpbm(colour)) == colour).all()
        assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P2 # c\n2 1\n15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4 3 1 \xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for broken in (b"", b"BM", b"P5 2 2 255 ab", b"P9 1 1 1", b"P5 x"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_texts_as_images(docs, rows):
    got = media.text_features(media.store_texts(docs)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert len(payload) % 576 == 0
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"], r["media_bytes"])) == (r["media_sha256"], r["feature"], r["media_bytes"])


def test_media_and_features_are_brute_force(docs, rows):
    """The stored image by its published format, and the feature by area means and by numpy's own file."""
    got = Counter((r["doc_id"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in media.text_features(media.store_texts(docs)).collect())
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)
        small = area_mean(pixels, 8, 9) if len(raw) < 3000 else media.resize(pixels, 8, 9)
        bits = "".join(str(int(b > a + 1e-9)) for row in small for a, b in zip(row, row[1:], strict=False))
        tile = np.floor((area_mean(pixels, 32, 32) if len(raw) < 3000 else media.resize(pixels, 32, 32)) + 0.5 + 1e-6).astype(np.uint8, order="C")
        file = io.BytesIO()
        np.save(file, tile)
        want[r[0], len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}:{zlib.crc32(file.getvalue()):08x}"] += 1
    assert got == want


def test_tiles_are_written_as_npy(docs):
    for r in media.text_tiles(media.store_texts(docs)).collect():
        assert np.load(io.BytesIO(r["tile"])).shape == (32, 32)


def test_tiles(spark):
    image = np.arange(64 * 64, dtype=np.uint32).reshape(64, 64).astype(np.uint8)
    out = {r["k"]: r for r in media.tiles(spark.createDataFrame([(1, bytearray(media.encode_netpbm(image))), (2, None), (3, bytearray(b"junk"))], "k long, m binary"), "k", "m").collect()}
    assert np.load(io.BytesIO(out[1]["tile"])).shape == (32, 32) and len(out[1]["dhash"]) == 16
    assert out[2]["tile"] is None and out[3]["dhash"] is None


def test_empty_table(empty):
    assert license_scan.scan(empty).count() == 0 and media.text_features(media.store_texts(empty)).count() == 0

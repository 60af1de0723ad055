r"""Operator 6, license scans: an Aho-Corasick automaton and a shunting-yard parser of licence expressions.

A text in lower case becomes words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; one automaton over the words, set apart by single
blanks, finds notice phrases and identifier tags at once, overlaps included. Behind an identifier tag stands an
expression of licence ids with `and`, `or`, `with` and parentheses; a shunting-yard parser evaluates how much it asks for
(permissive, weak or strong copyleft, restricted): `and` takes the stricter side, `or` the laxer one, and `with` relaxes
copyleft by a step. The automaton's hit says where an expression begins, behind a colon or not, and the longest beginning
of the line that is an expression counts: what follows it may be prose (`MIT. See the file`). A tag with no expression
behind it, or with one that breaks off at an operator or parenthesis, gets the label `spdx-invalid`.

Cases: null and empty texts have no words, places or labels and score 0; equal rows give equal rows; an empty table
gives no rows; a very long text is scanned whole, in one pass, and Arrow batches are handled in slices bounded by rows and
bytes; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, slices

#: Base phrases and labels of the contract, fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of the method, with labels and the confidence that each gives alone.
PHRASES = {
    "affero general public license": ("agpl", 0.7),
    "lesser general public license": ("lgpl", 0.7),
    "library general public license": ("lgpl", 0.7),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "bsd license": ("bsd", 0.6),
    "isc license": ("isc", 0.6),
    "boost software license": ("bsl", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons": ("cc", 0.4),
    "cc by": ("cc-by", 0.5),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0": ("cc0", 0.5),
    "public domain": ("public-domain", 0.3),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
BASE_CONFIDENCE = 0.6
TAG = "spdx license identifier"
TAG_CONFIDENCE = 0.9
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
BEFORE = re.compile(r"[ \t]*:?[ \t]*")
BLANKS = re.compile(r"[ \t]*")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

STRENGTHS = ("permissive", "weak-copyleft", "strong-copyleft", "restricted")
#: Beginnings of ids, by the index in STRENGTHS; the first that fits counts, others are restricted.
FAMILIES = (("lgpl", 1), ("mpl", 1), ("epl", 1), ("cddl", 1), ("agpl", 2), ("gpl", 2), ("cc-by-sa", 2), ("cc-by-nc", 3), ("cc-by-nd", 3), ("mit", 0), ("apache", 0), ("bsd", 0), ("isc", 0), ("zlib", 0), ("bsl", 0), ("unlicense", 0), ("cc0", 0), ("cc-by", 0), ("0bsd", 0), ("python", 0))
BINDING = {"or": 1, "and": 2, "with": 3}


def strength(license_id: str) -> int:
    return next((s for start, s in FAMILIES if license_id.startswith(start)), 3)


def longest(text: str, at: int) -> tuple[str, bool]:
    """The longest expression that stands at a place of a text in lower case, and whether it breaks off.

    Tokens are read while they fit what is due; the expression ends with the last token that leaves no operator and no
    parenthesis open. Nothing behind the first token that doesn't fit is read.
    """
    begin = upto = at
    operand, depth, ids, alone = True, 0, 0, ""
    while found := TOKEN.match(text, at):
        token = found[0]
        sentence = token[-1] in ".-" and token.rstrip(".-") != ""  # a full stop or dash behind an id
        token = token.rstrip(".-") if sentence else token
        if (token in BINDING or token == ")") == operand or (token == ")" and not depth):
            if not operand and token not in BINDING and token not in "()" and ids == 1 and strength(alone) == 3 and "-" not in alone:
                return "", True  # two plain words: prose, not a licence
            return text[begin:upto], operand or depth > 0 or token in BINDING or token in "()"
        if token in "()":
            depth += 1 if token == "(" else -1
        elif token not in BINDING:
            ids, alone = ids + 1, token
        operand = token in BINDING or token == "("
        at = found.start() + len(token)
        if not operand and not depth:
            upto = at
        if sentence:
            break
        at = BLANKS.match(text, at).end()
    return text[begin:upto], operand or depth > 0


def evaluate(expression: str) -> tuple[list[str], int]:
    """Licence ids of an expression and its strength. Raises ValueError where it isn't one."""
    values: list[tuple[int, str]] = []
    operators: list[str] = []
    ids: list[str] = []

    def reduce() -> None:
        name = operators.pop()
        if name == "(" or len(values) < 2:
            raise ValueError("unbalanced")
        (right, _), (left, _) = values.pop(), values.pop()
        values.append(({"or": min, "and": max}[name](left, right) if name != "with" else left - (left in (1, 2)), ""))

    operand = True  # an id or an opening parenthesis is due
    for token in TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                raise ValueError("operator missing")
            operators.append(token)
        elif token == ")":
            if operand:
                raise ValueError("licence missing")
            while operators and operators[-1] != "(":
                reduce()
            if not operators:
                raise ValueError("unbalanced")
            operators.pop()
        elif token in BINDING:
            if operand:
                raise ValueError("licence missing")
            while operators and operators[-1] != "(" and BINDING[operators[-1]] >= BINDING[token]:
                reduce()
            operators.append(token)
            operand = True
        else:
            if not operand:
                raise ValueError("operator missing")
            if not (operators and operators[-1] == "with"):  # behind `with` stands an exception
                ids.append(token)
            values.append((strength(token), token))
            operand = False
    if operand:
        raise ValueError("licence missing")
    while operators:
        reduce()
    return ids, values[0][0]


#: Every byte that isn't part of a word becomes a blank.
_BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def automaton() -> Any:
    """Phrases between blanks; the value of each is its text."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in {*BASE, *PHRASES, TAG}:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan_text(machine: Any, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    lowered = ascii_lower(text or "")
    words = lowered.translate(_BLANKS).split()
    flat = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    base: list[int] = []
    tags: list[int] = []
    base_labels, labels, doubt = set(), set(), 1.0
    seen: set[str] = set()
    spaces, upto = 0, 0
    for end, phrase in machine.iter(flat):
        if phrase in BASE or phrase == TAG:
            start = end - len(phrase) - 1  # of the blank before it
            spaces += flat.count(" ", upto, start) if start >= upto else -flat.count(" ", start, upto)
            upto = start
            if phrase == TAG:
                tags.append(spaces + TAG.count(" "))  # its last word
            else:
                base.append(spaces)
                base_labels.add(BASE[phrase])
        if phrase not in seen:
            seen.add(phrase)
            label, confidence = PHRASES.get(phrase, (BASE.get(phrase), BASE_CONFIDENCE))
            if label:
                labels.add(label)
                doubt *= 1 - confidence
    if tags:
        plain, wanted = lowered.decode("utf-8", "surrogatepass"), set(tags)
        for number, word in enumerate(WORD.finditer(plain)):
            if number not in wanted:
                continue
            expression, broken = longest(plain, BEFORE.match(plain, word.end()).end())
            if broken:
                labels.add("spdx-invalid")
            if expression:
                ids, level = evaluate(expression)
                labels.update(f"spdx:{i}" for i in ids)
                labels.add(f"spdx-{STRENGTHS[level]}")
                doubt *= 1 - TAG_CONFIDENCE
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), 1 - doubt


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in slices(batches):
            found = [scan_text(machine, t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

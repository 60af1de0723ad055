"""Fuzzy string similarity in [0, 1], from the published definitions.

`ratio` is twice the longest common subsequence over both lengths (normalized indel similarity), found by the
bit-parallel recurrence; `partial_ratio` slides the shorter text over the longer one; the token scorers sort or split
white-space tokens first; Jaro-Winkler adds 0.1 per common prefix character (four at most) to similarities above 0.7.

The UDF runs on Arrow batches and scores each distinct pair of a batch once, many pairs together in numpy, a 64-bit word
each; patterns of more than 62 characters and very long texts take the same recurrences one pair at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORERS = ("ratio", "partial_ratio", "jaro_winkler", "token_sort_ratio", "token_set_ratio")


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(masks: dict[str, int], n: int, other: str) -> int:
    full = (1 << n) - 1
    state = full
    for c in other:
        hit = state & masks.get(c, 0)
        state = (state + hit | state - hit) & full
    return n - state.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _common(_masks(a), len(a), b)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def _best_window(short: str, long: str) -> float:
    n = len(short)
    masks, best = _masks(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        if window[0 if end > len(long) else -1] not in masks:  # without that border the window could only be better
            continue
        best = max(best, 2 * _common(masks, n, window) / (n + len(window)))
        if best == 1.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length on the longer one, cut at both ends too."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not only_left or not only_right):
        return 1.0
    with_left, with_right = f"{both} {only_left}".strip(), f"{both} {only_right}".strip()
    found = ratio(with_left, with_right)
    return max(found, ratio(both, with_left), ratio(both, with_right)) if both else found


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, unused in zip(b, free, strict=True) if not unused]
    m = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    if base <= 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + 0.1 * prefix * (1 - base)


#: Characters of a pattern that a word holds, of a text beside it, pairs that run together, and words of a table of letters.
WORD, LONG, BLOCK, CELLS = 62, 256, 2048, 1 << 22

Pairs = list[tuple[str, str]]


class _Texts:
    """Distinct texts as rows of numbered letters (0 behind the end), and of each letter its places in a text as bits."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.sizes.max()) + WORD
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110001, bool)
        seen[letters + 1] = True
        self.letters = int(seen.sum()) + 1
        self.codes = np.zeros((len(texts), self.width), np.int32)
        self.codes[np.arange(self.width)[None, :] < self.sizes[:, None]] = np.cumsum(seen, dtype=np.int32)[letters + 1]

    def backwards(self) -> np.ndarray:
        at = self.sizes[:, None] - 1 - np.arange(self.width)[None, :]
        return np.where(at >= 0, np.take_along_axis(self.codes, np.maximum(at, 0), 1), 0)

    def table(self, codes: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(codes), self.letters), np.uint64), np.arange(len(codes))
        for i in range(min(WORD, self.width - WORD)):
            out[rows, codes[:, i]] |= np.uint64(1 << i)
        out[:, 0] = 0
        return out.ravel()


def _runs(pairs: Pairs, places: list[int]) -> Iterator[tuple[list[int], _Texts, np.ndarray, np.ndarray]]:
    """The pairs at these places, in runs whose tables stay small: the places, and both texts of each as rows."""
    if not places:
        return
    rows: dict[str, int] = {}
    first, second = (np.array([rows.setdefault(pairs[i][side], len(rows)) for i in places]) for side in (0, 1))
    texts = _Texts(list(rows))
    if len(rows) * texts.letters > CELLS and len(places) > 1:
        for half in (places[: len(places) // 2], places[len(places) // 2 :]):
            yield from _runs(pairs, half)
    else:
        yield places, texts, first, second


def _blocks(texts: _Texts, pattern: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    order = np.lexsort((texts.sizes[text], texts.sizes[pattern]))
    yield from (order[i : i + BLOCK] for i in range(0, len(order), BLOCK))


def _step(state: np.ndarray, masks: np.ndarray) -> None:
    """One character more; bits without a character of the pattern stay set."""
    hit = state & masks
    kept = state - hit
    state += hit
    state |= kept


def _start(n: int) -> np.ndarray:
    return np.full(n, ~np.uint64(0))


def _found(state: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~state).astype(np.int64)


def _by_size(pairs: Pairs) -> Pairs:
    return [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]


def _fitting(ordered: Pairs) -> tuple[list[int], list[int]]:
    """Places of the pairs that fit a word and a row, and of the others; the shorter text comes first."""
    fits = [0 < len(a) <= WORD and len(b) <= LONG for a, b in ordered]
    return [i for i, f in enumerate(fits) if f], [i for i, f in enumerate(fits) if not f]


def lcs_lengths(pairs: Pairs) -> np.ndarray:
    """`lcs` of each pair."""
    out, ordered = np.zeros(len(pairs), np.int64), _by_size(pairs)
    fits, others = _fitting(ordered)
    for i in others:
        out[i] = lcs(*ordered[i])
    for places, texts, short, long in _runs(ordered, fits):
        table, columns, at = texts.table(texts.codes), np.ascontiguousarray(texts.codes.T), np.array(places)
        for block in _blocks(texts, short, long):
            letter, state = short[block] * texts.letters, _start(len(block))
            for k in range(texts.sizes[long[block]].max()):
                _step(state, table[letter + columns[k][long[block]]])
            out[at[block]] = _found(state)
    return out


def _cut_windows(texts: _Texts, codes: np.ndarray, table: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The best ratio with a beginning of the text that is shorter than the pattern."""
    n, best, state, letter = texts.sizes[short], np.zeros(len(short)), _start(len(short)), short * texts.letters
    for k in range(n.max() - 1):
        _step(state, table[letter + codes[long, k]])
        best = np.maximum(best, np.where(n > k + 1, 2 * _found(state) / (n + k + 1), 0.0))
    return best


def _whole_windows(texts: _Texts, table: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The best ratio with a window as long as the pattern."""
    n, m = texts.sizes[short], texts.sizes[long]
    count = m - n + 1
    first = np.cumsum(count) - count
    at = np.repeat(long * texts.width - first, count) + np.arange(count.sum())
    letter, size, state, flat = np.repeat(short * texts.letters, count), np.repeat(n, count), _start(len(at)), texts.codes.ravel()
    for k in range(n.max()):
        _step(state, table[letter + np.where(size > k, flat[at + k], 0)])
    return np.maximum.reduceat(_found(state), first) / n


def _best_windows(pairs: Pairs) -> np.ndarray:
    """The best ratio of each pattern of 1 to WORD characters with a window of its text, cut at both ends too.

    Windows cut at the beginning are the steps of one run from there, those cut at the end of one run backwards.
    """
    out = np.empty(len(pairs))
    for places, texts, short, long in _runs(pairs, list(range(len(pairs)))):
        back = texts.backwards()
        ways = [(codes, texts.table(codes)) for codes in (texts.codes, back)]
        at = np.array(places)
        for block in _blocks(texts, short, long):
            a, b = short[block], long[block]
            cut = [_cut_windows(texts, *way, a, b) for way in ways]
            out[at[block]] = np.maximum(np.maximum(*cut), _whole_windows(texts, ways[0][1], a, b))
    return out


def partial_ratios(pairs: Pairs) -> np.ndarray:
    """`partial_ratio` of each pair."""
    out, ordered = np.empty(len(pairs)), _by_size(pairs)
    fits, others = _fitting(ordered)
    for i in others:
        out[i] = partial_ratio(*ordered[i])
    out[fits] = _best_windows([ordered[i] for i in fits])
    equal = [i for i in fits if len(ordered[i][0]) == len(ordered[i][1])]
    out[equal] = np.maximum(out[equal], _best_windows([ordered[i][::-1] for i in equal]))
    return out


def _ratio_of(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def ratios(pairs: Pairs) -> np.ndarray:
    """`ratio` of each pair."""
    return _ratio_of(lcs_lengths(pairs), np.array([len(a) + len(b) for a, b in pairs], np.int64))


def token_sort_ratios(pairs: Pairs) -> np.ndarray:
    """`token_sort_ratio` of each pair."""
    known = {t: " ".join(sorted(t.split())) for pair in pairs for t in pair}
    return ratios([(known[a], known[b]) for a, b in pairs])


def token_set_ratios(pairs: Pairs) -> np.ndarray:
    """`token_set_ratio` of each pair.

    The shared tokens begin both texts, so they are common as they stand, and only what follows them is compared.
    """
    known = {t: frozenset(t.split()) for pair in pairs for t in pair}
    out, places, rest, shared = np.zeros(len(pairs)), [], [], []
    for i, (a, b) in enumerate(pairs):
        left, right = known[a], known[b]
        if not left or not right:
            continue
        both = left & right
        if both and (len(both) == len(left) or len(both) == len(right)):
            out[i] = 1.0
            continue
        places.append(i)
        shared.append(sum(map(len, both)) + len(both) - 1 if both else -1)
        rest.append((" ".join(sorted(left - both)), " ".join(sorted(right - both))))
    if places:
        n = np.array(shared, np.int64)
        ends = [n + 1 + np.array([len(pair[side]) for pair in rest], np.int64) for side in (0, 1)]
        found = _ratio_of(n + 1 + lcs_lengths(rest), ends[0] + ends[1])
        one = np.maximum(_ratio_of(n, n + ends[0]), _ratio_of(n, n + ends[1]))
        out[places] = np.where(n >= 0, np.maximum(found, one), found)
    return out


def _in_front(letters: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen letters of each text, one after the other."""
    out = np.zeros(letters.shape, letters.dtype)
    rows, columns = np.nonzero(chosen)
    out[rows, (np.cumsum(chosen, axis=1) - 1)[rows, columns]] = letters[rows, columns]
    return out


def jaro_winklers(pairs: Pairs) -> np.ndarray:
    """`jaro_winkler` of each pair: the free places of the second text are bits of a word."""
    out, one = np.empty(len(pairs)), np.uint64(1)
    fits = [i for i, (a, b) in enumerate(pairs) if 0 < len(a) <= WORD and 0 < len(b) <= WORD]
    for i in set(range(len(pairs))).difference(fits):
        out[i] = jaro_winkler(*pairs[i])
    for places, texts, first, second in _runs(pairs, fits):
        table, at = texts.table(texts.codes), np.array(places)
        for block in _blocks(texts, first, second):
            a, b = first[block], second[block]
            n, m = texts.sizes[a], texts.sizes[b]
            left, right = texts.codes[a, :WORD], texts.codes[b, :WORD]
            letter, reach = b * texts.letters, np.maximum(0, np.maximum(n, m) // 2 - 1)
            free, chosen = _start(len(block)), np.zeros(left.shape, bool)
            for i in range(n.max()):
                near = ((one << np.minimum(i + reach + 1, 63).astype(np.uint64)) - one) & ~((one << np.maximum(i - reach, 0).astype(np.uint64)) - one)
                met = table[letter + left[:, i]] & free & near
                least = met & (~met + one)
                free &= ~least
                chosen[:, i] = least != 0
            taken = (free[:, None] >> np.arange(right.shape[1], dtype=np.uint64)[None, :]) & one == 0
            count = chosen.sum(axis=1)
            moved = (_in_front(left, chosen) != _in_front(right, taken)).sum(axis=1) // 2
            base = np.where(count > 0, (count / n + count / m + (count - moved) / np.maximum(count, 1)) / 3, 0.0)
            prefix = np.cumprod((left[:, :4] == right[:, :4]) & (left[:, :4] > 0), axis=1).sum(axis=1)
            out[at[block]] = np.where(base <= 0.7, base, base + 0.1 * prefix * (1 - base))
    return out


_BY_NAME: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "partial_ratio": partial_ratio, "jaro_winkler": jaro_winkler, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}

#: The same of many pairs at once.
_OF_MANY: dict[str, Callable[[Pairs], np.ndarray]] = {"ratio": ratios, "partial_ratio": partial_ratios, "jaro_winkler": jaro_winklers, "token_sort_ratio": token_sort_ratios, "token_set_ratio": token_set_ratios}


def score(a: Column, b: Column, names: tuple[str, ...] = SCORERS) -> Column:
    """Struct of the named scores of two text columns (null as empty), in one pass over Arrow batches."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            places: dict[tuple[str, str], int] = {}
            where = [places.setdefault(pair, len(places)) for pair in zip(left.fillna(""), right.fillna(""), strict=True)]
            yield pd.DataFrame({n: _OF_MANY[n](list(places))[where] if where else [] for n in names}, columns=list(names), dtype="float64")

    return scored(a, b)


def native_lcs(a: Column, b: Column) -> Column:
    """Longest common subsequence in higher-order functions alone, to check the UDF by."""
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(previous: Column, c: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            same = F.substring(b, j, F.lit(1)) == c
            value = F.when(same, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.element_at(out, -1)))
            return F.concat(out, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    done = F.aggregate(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)), start, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(done, -1))

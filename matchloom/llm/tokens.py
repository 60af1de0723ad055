"""Encoding of whole texts with a public tokenizer, one dictionary look-up per word.

The vocabulary's normalizer and pre-tokenizer treat white space as a separator and never join what stands on
either side of it, so the ids of a text are those of its blank-separated words put together. Words repeat far
more than texts do: Arrow finds the distinct words of some texts, the library encodes each of them once per worker, and
numpy puts the ids of all words together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER_FILE = "word_bpe_49k.json"
#: Words kept per Python worker; the ones first met stay. About 250 bytes each.
CACHE_WORDS = 500_000
#: Characters whose words are held at once.
CHUNK_CHARS = 5_000_000

_LOADED: dict[str, WordEncoder] = {}


#: Marks that compose with Latin letters; some of them with one case of a letter only.
_MARKS = re.compile("[\u0300-\u036f]")
#: Latin words that the normalizer leaves as they are.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_POINTED = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]+)").fullmatch


def _plain_case(text: str) -> str:
    """A-Z in lower case, which the normalizer does anyway, unless a mark could then compose otherwise."""
    if text.isascii():
        return text.lower()
    return text if _MARKS.search(text) else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges without the steps that leave plain lower-case words as they are.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer.from_file(path)  # byte-level symbols of ASCII letters are these letters
        self.ascii.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {"": b""}
        self.marker = "<|endoftext|>"
        self.marker_id = self.tokenizer.token_to_id(self.marker)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _cut(self, part: list[str], ids: np.ndarray, stops: np.ndarray, gap: int, into: dict[str, bytes]) -> None:
        raw, ends = ids.tobytes(), (4 * stops).tolist()
        starts = [0, *(end + 4 * gap for end in ends)]
        pieces = [raw[a:b] for a, b in zip(starts, ends, strict=False)]
        if len(pieces) != len(part):
            raise ValueError("the tokenizer splits words otherwise than assumed")
        into.update(zip(part, pieces, strict=True))

    def _learn(self, unknown: list[str], into: dict[str, bytes]) -> None:
        """Encode distinct words, thousands in one call.

        A lower-case Latin word is one run of the pre-tokenizer, so its last piece, and no other, ends a word; the
        punctuation behind it is a run of its own. Between all other words stand special tokens as borders.
        """
        known = self.known
        pointed, letters, other = [], set(), set()
        for word in unknown:
            if _LETTERS(word):
                letters.add(word)
            elif (found := _POINTED(word)) and "<|" not in word:
                stem, tail = found.groups()
                pointed.append((word, stem, tail))
                if stem not in known:
                    letters.add(stem)
                if tail not in known:
                    other.add(tail)
            else:
                other.add(word)
        for model, plain in ((self.ascii, [w for w in letters if w.isascii()]), (self.bare, [w for w in letters if not w.isascii()])):
            for start in range(0, len(plain), 4096):
                part = plain[start : start + 4096]
                (encoding,) = model.encode_batch_fast([" ".join(part)], add_special_tokens=False)
                ids = np.array(encoding.ids, dtype="<u4")
                self._cut(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0, into)
        plain = [w for w in other if "<|" not in w]
        for start in range(0, len(plain), 2048):
            part = plain[start : start + 2048]
            ids = self._ids(self.marker.join(part))
            self._cut(part, ids, np.append(np.flatnonzero(ids == self.marker_id), len(ids)), 1, into)
        for word in (w for w in other if "<|" in w):
            into[word] = self._ids(word).tobytes()
        for word, stem, tail in pointed:
            into[word] = (into[stem] if stem in into else known[stem]) + (into[tail] if tail in into else known[tail])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = []
        part: list[str] = []
        chars = 0
        for text in texts:  # the words of so many characters are in memory at once
            part.append(_plain_case(text or "").replace("\n", " "))
            chars += len(part[-1])
            if chars >= CHUNK_CHARS:
                out += self._encode_words(part)
                part, chars = [], 0
        return out + self._encode_words(part) if part else out

    def _encode_words(self, flat: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(flat, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        ids = self._ids_of(unique)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begin = np.cumsum(count) - count
        word = coded.indices.to_numpy()
        ends = np.cumsum(count[word])
        raw = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[word] - (ends - count[word]), count[word]) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        borders = (4 * np.append(0, ends)[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(borders, borders[1:], strict=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; the words first met stay, up to `cache_words`."""
        known = self.known
        found = list(map(known.get, words))
        unknown = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if not unknown:
            return found
        room, rest = max(0, self.cache_words - len(known)), {}
        self._learn(unknown[:room], known)
        self._learn(unknown[room:], rest)
        return [ids if ids is not None else known[word] if word in known else rest[word] for word, ids in zip(words, found, strict=True)]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)

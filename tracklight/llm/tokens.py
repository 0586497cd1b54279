"""Token ids of whole texts by the two public BPE vocabularies, equal to the tokenizers library's."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np

from tracklight.llm.bpe import byte_alphabet
from tracklight.llm.pretokens import beyond_low, word_level

#: Pre-tokens whose ids a worker keeps; beyond that it starts anew.
CACHE = 500_000


def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Numbers(dict):
    """A number for each word, in the order of arrival; the new ones are in fresh."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class _Rows:
    """Id sequences end to end, known by number."""

    def __init__(self) -> None:
        self.ids, self.first, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(rows) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(rows), "<u4", total)
        self.first[self.n : self.n + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(rows)] = sizes
        self.n, self.used = self.n + len(rows), self.used + total

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows end to end, and where each ends."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordTokens:
    """The word-end vocabulary: pre-tokens are cut and looked up in one pass, new ones go to the library together."""

    def __init__(self, path: str, end: int) -> None:
        self.tok, self.end = _library(path), end
        self._restart()

    def _restart(self) -> None:
        self.numbers, self.rows = _Numbers(), _Rows()
        self.rows.add([[self.end]])
        self.numbers[""] = 0  # no pre-token is empty: this one ends a text

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > CACHE:
            self._restart()
        cut = [word_level(t) for t in batch]
        known = [c for c in cut if c is not None]
        for c in known:
            c.append("")
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(known)), np.int64, sum(map(len, known)))
        if self.numbers.fresh:
            self.rows.add([e.ids for e in self.tok.encode_batch_fast(self.numbers.fresh, add_special_tokens=False)])
            self.numbers.fresh.clear()
        ids, ends = self.rows.take(numbers)
        texts_ = iter(np.split(ids, ends[np.cumsum([len(c) for c in known[:-1]], dtype=np.int64) - 1]) if known else [])
        return [np.array([*self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, self.end], "<u4") if c is None else next(texts_) for t, c in zip(batch, cut, strict=True)]


#: Between two words, where a pre-token of the byte-level vocabulary always begins.
_between_words = re.compile(r"[a-z](?= [a-z])").search
#: A text is cut there into parts of so many characters.
PART = 1 << 20


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART and (m := _between_words(text, at + PART)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class ByteTokens:
    """The byte-level vocabulary by merge ranks; texts with special tokens or beyond U+0250, where Unicode tables could differ
    between libraries, by the tokenizers library."""

    def __init__(self, path: str, end: int) -> None:
        import public_tokenizers
        import tiktoken

        self.tok, self.end = _library(path), end
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.plain = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> np.ndarray:
        if beyond_low(text) or "<|" in text:
            ids = [np.array([*self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids], "<u4")]
        else:
            ids = [np.array(self.plain.encode_ordinary(p), "<u4") for p in _parts(text)]
        return np.concatenate([*ids, np.array([self.end], "<u4")])

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return list(map(self._one, batch))

"""Byte-level BPE encoding and decoding with a pair occurrence index.

All new pre-tokens of a batch are laid end to end as byte symbols.  An index maps each adjacent pair to the positions where
it occurs; the active pairs are taken in ascending merge rank, merged at all their positions from left to right, and only
the lists of the pairs next to a merge are updated.  Pre-tokens never share a pair, so one pass over the batch encodes them
all.  Results are kept per pre-token in a bounded cache of the worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklight.llm.common import prepare, table, texts
from tracklight.llm.pretokens import byte_level

#: Pre-tokens a worker keeps; beyond that it starts anew.
CACHE = 500_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBPE:
    """A byte-level BPE vocabulary (the JSON form of the tokenizers library) applied through a pair occurrence index."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 17 | b: r for r, (a, b, _) in enumerate(self.parts)}
        self.byte_ranks = np.array([self.ranks.get(a << 17 | b, -1) for a in self.first for b in self.first])
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        if not words:
            return []
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        borders = np.cumsum([len(w) + 1 for w in words]) - 1
        sym = np.asarray(self.first)[raw]
        sym[borders] = -1  # part of no pair
        rank = self.byte_ranks[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[borders[:-1]] = -1
        rank[borders - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        seen, heads = np.unique(rank[at], return_index=True)
        lists = np.split(at, heads[1:]) if len(seen) else []
        where: dict[int, list[int]] = dict(zip(seen.tolist(), map(np.ndarray.tolist, lists), strict=True))
        sym, active = sym.tolist(), seen.tolist()
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        ranks, parts = self.ranks.get, self.parts
        while active:
            rank_ = heapq.heappop(active)
            if rank_ not in where:
                continue
            a, b, new = parts[rank_]
            positions = where.pop(rank_)
            positions.sort()
            for p in positions:
                q = nxt[p]
                if sym[p] != a or sym[q] != b:
                    continue  # another merge took one of the two
                sym[p], sym[q] = new, -2
                after, before = nxt[q], prv[p]
                nxt[p] = after
                prv[after] = p
                for place, hit in ((before, ranks(sym[before] << 17 | new)), (p, ranks(new << 17 | sym[after]))):
                    if hit is not None:
                        known = where.get(hit)
                        if known is None:
                            where[hit] = [place]
                            heapq.heappush(active, hit)
                        else:
                            known.append(place)
        out, s = [], 0
        for border in borders.tolist():
            ids = []
            while s != border:
                ids.append(sym[s])
                s = nxt[s]
            out.append(ids)
            s = border + 1
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        for w, ids in zip(new, self.merge_all([w.encode() for w in new]), strict=True):
            self.ids[w] = ",".join(map(str, ids))
            said = self.decode(ids)
            self.back[w] = w if said == w else said

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens, with special tokens as pieces of their own."""
        if not any(s in text for s in self.special):
            return byte_level(text)
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [t for i, p in enumerate(parts) for t in ([p] if i % 2 else byte_level(p))]

    def encode_texts(self, batch: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids in decimal, joined by commas, and the text decoded from these ids."""
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.back.clear()
        for s, i in self.special.items():
            self.ids[s], self.back[s] = str(i), s
        known = self.ids.keys()
        cut = [self.pieces(t) for t in batch]
        self._learn({w for c in cut for w in set(c) if w not in known})
        ids, back = self.ids.__getitem__, self.back.__getitem__
        for c in cut:
            yield ",".join(map(ids, c)), "".join(map(back, c))


_loaded: dict[str, PairIndexBPE] = {}


def coder_for(path: str) -> PairIndexBPE:
    """The worker's coder, loaded once."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (decimal, comma-joined), n_tokens and the decoded text of every document.

    vocabulary: path of a byte-level BPE JSON file, present on every executor.  A null text counts as empty; an empty text
    has no ids; rows that repeat a doc_id or a text are encoded row by row; other columns are ignored; an empty table gives
    an empty result.  No shuffle: each input partition is encoded where it is read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        from tracklight.llm import bpe

        coder = bpe.coder_for(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                found = list(coder.encode_texts(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([i.count(",") + 1 if i else 0 for i, _ in found], pa.int64()), pa.array([i for i, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As encode_decode, with SHA-256 digests made in the worker in place of ids and text, which then never leave it."""
    prepare(docs.sparkSession)

    def run(batches):
        from tracklight.llm import bpe

        coder, sha = bpe.coder_for(vocabulary), hashlib.sha256
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                rows = [(i.count(",") + 1 if i else 0, sha(i.encode()).hexdigest(), sha(t.encode()).hexdigest()) for i, t in coder.encode_texts(part.column("text").to_pylist())]
                n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

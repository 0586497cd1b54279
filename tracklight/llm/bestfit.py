"""Packing by patterns of few documents whose repeat counts are fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, table
from tracklight.llm.packing import cut_pieces, place
from tracklight.llm.tokens import ByteTokens

#: Most steps of the fit, and the relative change at which it ends.
STEPS, CHANGE = 1500, 1e-5


def short_first(n: int, capacity: int) -> range | list[int]:
    """Where the pieces of a text of n ids begin: all full but the first."""
    return [0, *range(n % capacity, n, capacity)] if n > capacity and n % capacity else range(0, n, capacity)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three of the lengths, longest first and filled up with 0, that fill a sequence wholly."""
    lengths = np.sort(lengths)
    first, second = np.meshgrid(lengths, np.append(lengths, 0), indexing="ij")
    pair = (first >= second) & (first + second <= capacity)
    a, b = first[pair], second[pair]
    room = np.minimum(capacity - a - b, b)
    at = np.searchsorted(lengths, room, side="right") - 1
    c = np.where((at >= 0) & (room > 0), lengths[np.maximum(at, 0)], 0)
    found = np.stack([a, b, c], 1)
    return np.unique(found[found.sum(1) == capacity], axis=0)


def fit(rows: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How often each pattern is used, not negative, so that the squares of what is left or too much of each length (weighted by
    the length, as long pieces are the hard ones) are least: projected gradient steps with momentum.  counts[0] isn't read."""
    weight = np.arange(len(counts)) / capacity
    target = counts * weight

    def used(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(rows[:, j], x, len(counts)) for j in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[rows].sum(1)

    probe = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = back(used(probe))
        largest = np.linalg.norm(probe)
        probe /= largest
    x = look = np.zeros(len(rows))
    pace, size = 1.0, max(1.0, np.linalg.norm(target))
    for step in range(STEPS):
        new = np.maximum(0, look - back(used(look) - target) / (1.01 * largest))
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look = new + (pace - 1) / faster * (new - x)
        moved, x, pace = np.linalg.norm(used(new - x)) / size, new, faster
        if step > 20 and moved < CHANGE:
            break
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole repeat counts that stay within the histogram; counts becomes what they leave.  Fractions are carried on
    from pattern to pattern in order of their lengths, so that sparse lengths aren't rounded away."""
    order = np.lexsort(rows.T[::-1])[::-1]
    whole = np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0).astype(np.int64)
    out = []
    for row, n in zip(rows[order[whole > 0]], whole[whole > 0].tolist(), strict=True):
        kinds, times = np.unique(row[row > 0], return_counts=True)
        n = min(n, int((counts[kinds] // times).min()))
        if n > 0:
            counts[kinds] -= n * times
            out.append((row[row > 0], n))
    return out


def pattern_packing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, first sequence, offset), sorted, for pieces of the given lengths.

    Few-document patterns, their fitted and rounded repeat counts, then the residual, longest first, each into the fullest
    sequence that it fits; sequences of one kind are one run, so that work and slots depend on the histogram alone.
    """
    counts, slots, total = np.zeros(capacity + 1, np.int64), [], 0
    for length, n in histogram.items():
        counts[length] = n
    ranks = np.zeros(capacity + 1, np.int64)
    room: dict[int, list[tuple[int, int]]] = {}  # empty ids -> runs (first sequence, number)
    free: list[int] = []

    def put(length: int, seq: int, offset: int, n: int) -> None:
        slots.append((length, int(ranks[length]), seq, offset))
        ranks[length] += n

    def leave(empty: int, seq: int, n: int) -> None:
        if empty and n:
            if empty not in room:
                insort(free, empty)
            room.setdefault(empty, []).append((seq, n))

    if histogram:
        rows = patterns(np.flatnonzero(counts), capacity)
        fitted = rounded(rows, fit(rows, counts, capacity), counts) if len(rows) else []
        for row, n in fitted:
            offset = 0
            for length in row.tolist():
                put(length, total, offset, n)
                offset += length
            total += n
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                empty = free[at]
                seq, n = room[empty].pop()
                if not room[empty]:
                    del room[empty], free[at]
            else:
                empty, seq, n = capacity, total, -(-left // (capacity // length))
                total += n
            each = min(empty // length, left)  # the fullest sequence that it fits is the one it just went to
            packs = min(n, left // each)
            for k in range(each):
                put(length, seq, capacity - empty + k * length, packs)
            left -= each * packs
            leave(empty - each * length, seq, packs)
            leave(empty, seq + packs, n - packs)
    return np.array(sorted(slots), np.int64).reshape(-1, 4)


def pack_patterns(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Every id of every document in exactly one piece, and each piece in a sequence of at most `capacity` ids, in few sequences.

    Returns doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Only documents of more than `capacity` ids
    are cut: into full pieces, but for the first.  A null or empty text has the end id alone; repeated rows are packed row by
    row; other columns are ignored; an empty table gives an empty result; a text may have any length.  The driver sees at most
    `capacity` histogram rows, whatever the number of documents.
    """
    pieces = materialise(cut_pieces(docs, ByteTokens, vocabulary, end_id, capacity, short_first), "pieces")
    return place(pieces, lambda h: pattern_packing(h, capacity)).withColumn("piece", F.col("piece").cast("int"))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_patterns(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

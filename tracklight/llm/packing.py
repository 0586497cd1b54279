"""Packing of token sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table, texts
from tracklight.llm.tokens import WordTokens

PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens")
_loaded: dict[tuple, object] = {}


def full_first(n: int, capacity: int) -> range:
    """Where the pieces of a text of n ids begin: all full but the last."""
    return range(0, n, capacity)


def cut_pieces(docs: DataFrame, coder: type, vocabulary: str, end_id: int, capacity: int, cut: Callable[[int, int], range]) -> DataFrame:
    """One row per piece of at most `capacity` ids, cut where `cut` says, with the piece's rank among the pieces of its length in
    its partition."""
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        from tracklight.llm import packing

        at = (coder, vocabulary, end_id)
        if at not in packing._loaded:
            packing._loaded[at] = coder(vocabulary, end_id)
        tokens, part, seen = packing._loaded[at], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                rows = b.slice(lo, 200)
                out: list[tuple] = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), tokens.encode(rows.column("text").to_pylist()), strict=True):
                    starts = cut(len(ids), capacity)
                    for k, s in enumerate(starts):
                        e = starts[k + 1] if k + 1 < len(starts) else len(ids)
                        out.append((doc, k, s, e - s, zlib.crc32(ids[s:e]), len(ids), part, int(seen[e - s])))
                        seen[e - s] += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*PIECE, "part", "local_rank"])

    return texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in (*PIECE, "part", "local_rank")))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, first sequence, offset), sorted, for pieces of the given lengths.

    Lengths are placed longest first.  Packs with the same pattern of lengths are one entry (a run of sequence ids), so work
    depends on the histogram, not on the number of pieces.  A length goes to the emptiest packs (the smallest sum) that it
    fits; if it needs only some packs of a pattern, the pattern's run is split; what fits no pack opens new ones.
    """
    packs: list[tuple[int, int, int]] = []  # heap of (sum, first sequence, number)
    slots, total = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= capacity:
                fill, seq, n = heapq.heappop(packs)
                took = min(left, n)
                if took < n:
                    heapq.heappush(packs, (fill, seq + took, n - took))
            else:
                fill, seq, took = 0, total, left
                total += left
            slots.append((length, rank, seq, fill))
            if fill + length < capacity:
                heapq.heappush(packs, (fill + length, seq, took))
            rank += took
            left -= took
    return np.array(sorted(slots), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, layout: Callable[[dict[int, int]], np.ndarray]) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset.  layout makes slots from the histogram of lengths: rows (length,
    first rank, first sequence, offset), sorted, each for the ranks up to the next row of its length.

    The driver sees the histogram alone; the slots made from it go to the workers.  A piece's rank among those of its length is
    its rank in its partition plus the sum of earlier partitions, so no length, however common, meets in one task.
    """
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(layout(histogram))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select(*PIECE, (F.col("base") + F.col("local_rank")).alias("rank"))

    def put(batches):
        s = slots.value
        keys = s[:, 0] * (1 << 40) + s[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PIECE), pa.array(s[k, 2] + rank - s[k, 1]), pa.array(s[k, 3])], names=[*PIECE, "sequence_id", "offset"])

    return ranked.mapInArrow(put, ", ".join(f"{c} long" for c in (*PIECE, "sequence_id", "offset")))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Every id of every document in exactly one piece, and each piece in a sequence of at most `capacity` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text has the end id alone;
    repeated rows are packed row by row; other columns are ignored; an empty table gives an empty result; a text may have any
    length.  The driver sees at most `capacity` histogram rows.
    """
    pieces = materialise(cut_pieces(docs, WordTokens, vocabulary, end_id, capacity, full_first), "pieces")
    return place(pieces, lambda h: shortest_pack_first(h, capacity)).drop("piece")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

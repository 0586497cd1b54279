"""Importance resampling towards a target corpus, through inverted postings of hashed features.

Postings (bucket, document, count) are packed by blocks of documents and slots of buckets.  They are shuffled by slot; there the
feature counts of both corpora meet, give each bucket's gain, and every posting adds its count times the gain to its document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table, texts
from tracklight.operators.ranks import gapless_rank

BUCKETS = 10_000
#: Buckets are dealt into so many slots by their number; a slot's postings spread over as many tasks as their size asks for.
SLOTS = 16
WIDTH = BUCKETS // SLOTS
#: Blocks of documents whose postings of one slot meet in one task.
BLOCKS = 64
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Words of a target sample and documents drawn, per cent.
LEAST_WORDS, SHARE = 20, 5

_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_gap = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]").search
DOCUMENTS, TOTALS, POSTINGS = 0, 1, 2
_ROWS = "kind int, block long, slot int, doc_id array<long>, n_words array<long>, n_features array<long>, counts array<long>, postings binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _word_lists(text: str) -> Iterator[list[bytes]]:
    """All words, A to Z in lower case, in lists of a bounded size."""
    data, at = text.encode().lower(), 0
    while at < len(data):
        gap = _gap(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield _words(data[at:end])
        at = end


def features(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of the text: its words, and the buckets of the runs of one to three words that end in it.  The checksum of
    a run goes on from that of the run without its last word."""
    before: list[bytes] = []
    for words in _word_lists(text):
        run = before + words
        spaced = [b" " + w for w in run]
        one = list(map(zlib.crc32, run))
        two = list(map(zlib.crc32, spaced[1:], one))
        three = list(map(zlib.crc32, spaced[2:], two))
        k = len(before)
        found = one[k:] + two[max(0, k - 1) :] + three[max(0, k - 2) :]
        yield len(words), np.array(found, np.uint32) % np.uint32(BUCKETS)
        before = run[-2:]


def _packed(bucket: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """Postings of one slot, sorted by bucket and document: the bytes of three columns, the documents as differences."""
    sizes = np.bincount(bucket, minlength=WIDTH).astype("<u4")
    gaps = np.diff(doc, prepend=0)
    return pa.compress(sizes.tobytes() + gaps.astype("<i4").tobytes() + count.astype("<u4").tobytes(), codec="zstd", asbytes=True) + (4 * WIDTH + 8 * len(doc)).to_bytes(8, "little")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), "zstd", asbytes=True), "<u4")
    n = (len(raw) - WIDTH) // 2
    return np.repeat(np.arange(WIDTH), raw[:WIDTH]), np.cumsum(raw[WIDTH : WIDTH + n].view("<i4"), dtype=np.int64), raw[WIDTH + n :].astype(np.int64)


def _block(docs: list[int | None], texts_: list[str]) -> Iterator[dict]:
    """Rows of one block of documents: the documents, and counts and postings of each slot."""
    words, sizes, keys, counts = [], [], [], []
    for i, t in enumerate(texts_):
        n = total = 0
        own: tuple[np.ndarray, np.ndarray] | None = None
        for k, found in features(t):
            n, total = n + k, total + len(found)
            bucket, c = np.unique(found, return_counts=True)
            if own is not None:
                both = np.bincount(own[0], own[1], BUCKETS) + np.bincount(bucket, c, BUCKETS)
                bucket = np.flatnonzero(both)
                c = both[bucket].astype(np.int64)
            own = bucket, c
        words.append(n)
        sizes.append(total)
        if own is not None and len(own[0]):
            keys.append(own[0].astype(np.int64) * len(texts_) + i)
            counts.append(own[1])
    yield {"kind": DOCUMENTS, "doc_id": docs, "n_words": words, "n_features": sizes}
    if not keys:
        return
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    bucket, doc = key // len(texts_), key % len(texts_)
    edges = np.searchsorted(bucket, np.arange(SLOTS + 1) * WIDTH)
    for slot, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            here = bucket[a:b] - slot * WIDTH
            yield {"kind": TOTALS, "slot": slot, "counts": np.bincount(here, count[a:b], WIDTH).astype(np.int64)}
            yield {"kind": POSTINGS, "slot": slot, "postings": _packed(here, doc[a:b], count[a:b])}


def postings(docs: DataFrame) -> DataFrame:
    """Rows of three kinds for each block of at most 1000 documents: its documents (doc_id, n_words, n_features), and for each
    slot of buckets the feature counts and the packed postings."""
    prepare(docs.sparkSession)
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _ROWS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = [dict.fromkeys(_NAMES) | r | {"block": block} for r in _block(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            block += 1

    return texts(docs).mapInArrow(run, _ROWS)


def gains(mine: np.ndarray, target: np.ndarray, mine_all: int, target_all: int) -> np.ndarray:
    """The gain of each bucket of a slot: floor(1000 ln) of its smoothed share in the target over that in the corpus."""
    ratio = (target + 1.0) * (mine_all + float(BUCKETS)) / ((mine + 1.0) * (target_all + float(BUCKETS)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def _contributions(mine_all: int, target_all: int):
    """Of rows sorted by slot, salt and kind: (block, no, weight) that each slot adds to the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, gain = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("kind", "slot", "block")}
                if row["kind"] == TOTALS:
                    mine, target = (np.asarray(b.column(n)[r].values, np.float64) for n in ("counts", "target"))
                    slot, gain = row["slot"], gains(mine, target, mine_all, target_all)
                    continue
                if row["slot"] != slot:
                    raise ValueError("postings without the counts of their slot")
                bucket, doc, count = _unpacked(b.column("postings")[r].as_py())
                part = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(part, doc, gain[bucket] * count)
                no = np.unique(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), row["block"])), pa.array(no), pa.array(part[no])], names=["block", "no", "weight"])

    return run


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """slot and the sums of its buckets, as an array in their order.  At most BUCKETS rows leave a task."""
    each = rows.where(F.col("kind") == TOTALS).select("slot", F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("slot", "at").agg(F.sum("n").alias("n"))
    filled = F.map_from_entries(F.collect_list(F.struct("at", "n")))
    return each.groupBy("slot").agg(filled.alias("m")).select("slot", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias(name))


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs: the gains of its features, summed.

    A null text has no features and weighs 0; repeated rows are rows of their own; an empty corpus gives no rows, an empty target
    counts none; texts of any length and further columns of any name are fine; target(text) needs no other column.
    """
    mine = materialise(postings(docs), "postings")
    theirs = materialise(postings(target.select(F.lit(0).alias("doc_id"), "text")), "postings")
    size = lambda rows: rows.where(F.col("kind") == DOCUMENTS).agg(F.sum(F.aggregate("n_features", F.lit(0).cast("long"), lambda a, x: a + x)), F.count(F.lit(1))).first()
    (all_mine, n_blocks), (all_target, _) = size(mine), size(theirs)
    salts = max(1, -(-n_blocks // BLOCKS))
    # Both corpora's counts of a slot, one row for each salt; its postings follow them to the same task.
    counts = _summed(mine, "counts").join(_summed(theirs, "target"), "slot", "left").withColumn("target", F.coalesce("target", F.array_repeat(F.lit(0).cast("long"), WIDTH)))
    heads = counts.select(F.lit(TOTALS).alias("kind"), F.lit(None).cast("long").alias("block"), "slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "counts", "target", F.lit(None).cast("binary").alias("postings"))
    none = F.lit(None).cast("array<long>")
    dealt = mine.where(F.col("kind") == POSTINGS).select("kind", "block", "slot", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), none.alias("counts"), none.alias("target"), "postings")
    met = heads.unionByName(dealt).repartition("slot", "salt").sortWithinPartitions("slot", "salt", "kind")
    added = met.mapInArrow(_contributions(all_mine or 0, all_target or 0), "block long, no long, weight long").groupBy("block", "no").agg(F.sum("weight").alias("weight"))
    rows = mine.where(F.col("kind") == DOCUMENTS).select("block", F.posexplode(F.arrays_zip("doc_id", "n_words", "n_features")).alias("no", "r"))
    return rows.select("block", F.col("no").cast("long").alias("no"), "r.*").join(added, ["block", "no"], "left").select("doc_id", "n_words", "n_features", F.coalesce("weight", F.lit(0)).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: rank 1, 2, 3, … for the drawn ones, in order of their scores.

    Scores are weights with Gumbel noise that the seed and doc_id decide.  Rows that share a doc_id share its noise; ties go to the
    smaller doc_id (null first), then the fewer features.  See weights() for odd rows.
    """
    weighed = weights(docs, target)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = materialise(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    ranked = gapless_rank(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")], None, "place", materialise)
    drawn = SHARE * able.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ranked.withColumn("rank", rank).drop("place").unionByName(scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

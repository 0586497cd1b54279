"""Quality rules: base rules on whole texts, then an isolation forest on the rule statistics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table, texts, word_list

_symbols = re.compile(r"[#*$%&|<>]").findall
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of STATS for one whole text."""
    text = text or ""
    words = word_list(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif word_list(line):
            seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[str, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * np.int64(len(ids)) + code[2:], return_inverse=True, return_counts=True)
        often = times[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= often
        repeat = int(covered.sum())
    return n, sum(map(len, words)), len(_symbols(text)), dup, repeat


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every document, from its whole text (null: no words)."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [text_stats(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *STATS])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def features(x: np.ndarray) -> np.ndarray:
    """Rates that rules look at, from the counts in the order of STATS."""
    n = np.maximum(x[:, 0], 1)
    return np.stack([x[:, 1] / n, x[:, 2] / n, np.log1p(x[:, 3]), x[:, 4] / n], 1)


class IsolationForest:
    """Random axis-parallel splits of subsamples; rows that few splits isolate have short paths and scores near 1."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 2048, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = max(2, min(sample, len(x)))
        depth = int(np.ceil(np.log2(self.size)))
        self.nodes = []  # per tree: feature (-1 at a leaf), split, left child, path length at the leaf
        for _ in range(trees):
            feature, split, left, length = [], [], [], []
            todo = [(x[rng.choice(len(x), self.size, replace=len(x) < self.size)], 0, self._new(feature, split, left, length))]
            while todo:
                rows, d, at = todo.pop()
                lo, hi = rows.min(0), rows.max(0)
                open_ = np.flatnonzero(hi > lo)
                if d >= depth or len(rows) < 2 or not len(open_):
                    length[at] = d + self.mean_path(len(rows))
                    continue
                f = int(rng.choice(open_))
                s = rng.uniform(lo[f], hi[f])
                feature[at], split[at] = f, s
                left[at] = self._new(feature, split, left, length)
                self._new(feature, split, left, length)
                todo += [(rows[rows[:, f] < s], d + 1, left[at]), (rows[rows[:, f] >= s], d + 1, left[at] + 1)]
            self.nodes.append((np.array(feature), np.array(split), np.array(left), np.array(length)))
        self.depth = depth

    @staticmethod
    def _new(*cols: list) -> int:
        for c, v in zip(cols, (-1, 0.0, 0, 0.0), strict=True):
            c.append(v)
        return len(cols[0]) - 1

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, split, left, length in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= split[at]
                at = np.where(go, left[at] + right, at)
            total += length[at]
        return 2.0 ** (-total / len(self.nodes) / max(self.mean_path(self.size), 1e-9))


def calibrated(good: np.ndarray, bad: np.ndarray, least_kept: float) -> int:
    """The lowest score bin from which rows are rejected: the one with the best balanced accuracy among those that keep at
    least `least_kept` of the good labelled rows (one bin past the last: reject none)."""
    kept = np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1)
    caught = 1 - np.concatenate([[0], np.cumsum(bad)]) / max(bad.sum(), 1)
    return int(np.argmax(np.where(kept >= least_kept, kept + caught, -1)))


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least_kept: float = 0.98, bins: int = 2000) -> DataFrame:
    """doc_id, STATS, score (of the isolation forest), base_failed and kept for every document.

    fit_rows bounds the sample of documents that the forest is fitted on: well-labelled ones (quality 1) whose hash of doc_id is
    below a threshold, one row for each doc_id.  The threshold is calibrated on all labelled rows through a histogram of their scores.
    A null text has no words and fails the base rules, as an empty one; repeated rows are judged row by row; other columns
    are ignored.  Without labels the forest rejects nothing.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    stats = materialise(rule_stats(docs), "stats")
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    passed = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    known = stats.where(passed).join(label.where("quality = 1"), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s"))
    share = 0.95 * fit_rows / max(known.count(), 1)  # the few rows that chance adds stay below fit_rows
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(share, 1) * (1 << 30)))
    fit = sorted(chosen.select("s.*").limit(fit_rows).collect())
    if not fit:
        return stats.withColumns({"score": F.lit(0.0), "base_failed": ~passed, "kept": passed})
    shared = spark.sparkContext.broadcast(IsolationForest(features(np.array(fit, np.float64))))

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(b.column(c), np.float64) for c in STATS], 1) if b.num_rows else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(features(x)))], names=[*b.schema.names, "score"])

    scored = materialise(stats.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *STATS)) + ", score double"), "scored")
    bin_ = F.floor(F.col("score") * bins).cast("int")
    counted = scored.where(passed).join(label, "doc_id").groupBy(bin_.alias("bin"), "quality").count().collect()
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in counted:
        (good if r["quality"] else bad)[min(r["bin"], bins)] += r["count"]
    limit = calibrated(good, bad, least_kept) if bad.sum() else bins + 1
    return scored.withColumns({"base_failed": ~passed, "kept": passed & (bin_ < limit)})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

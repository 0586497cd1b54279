"""Toxicity: a chain of linear classifiers over hashed words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table, texts

_words = re.compile(r"[^\W\d_]+").findall


def terms(text: str) -> set[str]:
    """The distinct lower-case letter runs of a text."""
    return set(_words(text.lower()))


@dataclass
class LinearModel:
    """Logistic regression on presence of terms and on the probabilities of earlier categories."""

    weights: dict[str, float]
    chain: np.ndarray
    bias: float

    def predict(self, sets: list[set[str]], earlier: np.ndarray) -> np.ndarray:
        get, keys = self.weights.__getitem__, self.weights.keys()
        z = np.array([sum(map(get, s & keys)) for s in sets], np.float64).reshape(-1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z + earlier @ self.chain, -30, 30)))


def gains(with_term: np.ndarray, positive: np.ndarray, rows: float, total: float) -> np.ndarray:
    """Log-likelihood ratio of terms: how many rows have each, how many positive ones; all rows and all positive ones."""

    def entropy(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
        q = np.clip(a / np.maximum(b, 1e-9), 1e-9, 1 - 1e-9)
        return b * (q * np.log(q) + (1 - q) * np.log(1 - q))

    return entropy(positive, with_term) + entropy(total - positive, rows - with_term) - entropy(total, rows)


#: Terms that a model takes at most, rows that must have a term, and the gain that chance seldom gives.
TERMS, SEEN, STRONG = 200, 3, 8


def choose_terms(names: list[str], count: np.ndarray, positive: np.ndarray, rows: float, total: float) -> list[str]:
    """The terms whose presence tells most about a category, best first."""
    if not 0 < total < rows or not names:
        return []
    gain = np.where(count >= SEEN, gains(count, positive, rows, total), 0)
    return [names[i] for i in sorted(np.flatnonzero(gain > STRONG), key=lambda i: (-gain[i], names[i]))[:TERMS]]


def fit_linear(names: list[str], sets: list[set[str]], y: np.ndarray, earlier: np.ndarray, rounds: int = 300) -> LinearModel:
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(sets), len(names) + earlier.shape[1]))
    for r, s in enumerate(sets):
        x[r, [at[t] for t in s & at.keys()]] = 1
    x[:, len(names) :] = earlier
    w, b, step = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    mw, mb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        mw, mb = 0.9 * mw + x.T @ g / len(y) + 1e-4 * w, 0.9 * mb + g.mean()
        w, b = w - step * mw, b - step * mb
    return LinearModel({t: float(w[i]) for t, i in at.items()}, w[len(names) :], float(b))


FOLDS = 5


def fit_chain(sets: list[set[str]], fold: np.ndarray, targets: np.ndarray, names: list[str], counts: np.ndarray) -> list[LinearModel]:
    """One model per column of targets; each sees the earlier columns' probabilities, in training those that models fitted
    without the row's fold gave.  counts: for each term, fold and column (0: all rows) how many rows have it and are positive."""
    earlier, chain = np.zeros((len(sets), 0)), []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(np.float64)

        def fitted(inside: np.ndarray, c: np.ndarray, y=y, k=k, earlier=earlier) -> LinearModel:
            chosen = choose_terms(names, c[:, 0], c[:, k + 1], len(inside), y[inside].sum())
            return fit_linear(chosen, [sets[i] for i in inside], y[inside], earlier[inside])

        chain.append(fitted(np.arange(len(sets)), counts.sum(1)))
        out = np.zeros(len(sets))
        for f in range(FOLDS):
            inside, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(held):
                out[held] = fitted(inside, counts.sum(1) - counts[:, f]).predict([sets[i] for i in held], earlier[held])
        earlier = np.column_stack([earlier, out])
    return chain


#: The categories in the order of the chain: poor text, toxic text, and both at once.
CATEGORIES = ("poor", "toxic", "toxic_and_poor")


def counted_terms(sample: DataFrame, targets: np.ndarray, fold: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The terms that any model of the chain may choose, and for each term and fold how many rows have it, in all and in each
    category.  Terms are counted on Spark; only those among the best TERMS of a category, in all folds or without one, come back:
    at most TERMS times the number of models."""
    poor = 1 - F.col("quality")
    kinds = (F.lit(1), poor, F.col("toxic"), F.col("toxic") * poor)
    sums = [F.sum(F.when(F.col("fold") == f, kind).otherwise(0)).alias(f"n{f}_{k}") for f in range(FOLDS) for k, kind in enumerate(kinds)]
    counts = materialise(sample.select("fold", "toxic", "quality", F.explode("terms").alias("term")).groupBy("term").agg(*sums).where(" + ".join(f"n{f}_0" for f in range(FOLDS)) + f" >= {SEEN}"), "terms")
    wanted = []
    for k in range(targets.shape[1]):
        for left_out in (None, *range(FOLDS)):
            inside = fold != left_out if left_out is not None else np.ones(len(fold), bool)
            rows, total = float(inside.sum()), float(targets[inside, k].sum())
            if not 0 < total < rows:
                continue
            n, p = (sum((F.col(f"n{f}_{c}") for f in range(FOLDS) if f != left_out), F.lit(0)).cast("double") for c in (0, k + 1))

            def entropy(a, b):
                q = F.greatest(F.least(a / F.greatest(b, F.lit(1e-9)), F.lit(1 - 1e-9)), F.lit(1e-9))
                return b * (q * F.log(q) + (1 - q) * F.log(1 - q))

            gain = entropy(p, n) + entropy(F.lit(total) - p, F.lit(rows) - n)
            wanted.append(counts.select("term", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(TERMS).select("term"))
    if not wanted:
        return [], np.zeros((0, FOLDS, 4))
    chosen = wanted[0]
    for w in wanted[1:]:
        chosen = chosen.unionByName(w)
    found = sorted(counts.join(chosen.distinct(), "term", "left_semi").collect(), key=lambda r: r["term"])
    return [r["term"] for r in found], np.array([[[r[f"n{f}_{k}"] for k in range(4)] for f in range(FOLDS)] for r in found], np.float64).reshape(-1, FOLDS, 4)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, bins: int = 1000) -> DataFrame:
    """doc_id, tag (a hash of the text, as empty if null), one probability per category (p_poor, p_toxic, p_toxic_and_poor) and
    is_toxic for every document.

    fit_rows bounds the labelled documents that the chain is fitted on (half of them toxic where there are enough): those with
    the smallest hashes of doc_id, one text for each; a model takes at most TERMS terms.  Every text is then scored whole, and the threshold on p_toxic is the one with the best F1 over
    all labelled rows, through a histogram.  A null text counts as empty; repeated rows are scored row by row; a document with
    several labels is toxic if one says so; other columns are ignored; without labels of both kinds nothing is toxic; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    doc = texts(docs).withColumn("tag", F.xxhash64("text"))
    label = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.min(F.coalesce(F.col("quality"), F.lit(1))).cast("int").alias("quality"))
    order = (F.xxhash64("doc_id"), "doc_id")
    pick = label.where("toxic = 1").orderBy(*order).limit(fit_rows // 2).unionByName(label.where("toxic = 0").orderBy(*order).limit(fit_rows - fit_rows // 2))

    one = doc.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"), F.min("quality").alias("quality"))

    def reduce_(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "quality", "fold")), pa.array([sorted(terms(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["doc_id", "toxic", "quality", "fold", "terms"])

    kept = one.select("doc_id", "toxic", "quality", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    sample = materialise(kept.mapInArrow(reduce_, "doc_id long, toxic int, quality int, fold int, terms array<string>"), "sample")
    rows = sample.select("doc_id", "toxic", "quality", "fold").orderBy("doc_id").collect()
    toxic, poor, fold = (np.array([f(r) for r in rows], np.int64) for f in (lambda r: r["toxic"], lambda r: 1 - r["quality"], lambda r: r["fold"]))
    if len(np.unique(toxic)) < 2:
        return doc.select("doc_id", "tag", *(F.lit(0.0).alias(f"p_{c}") for c in CATEGORIES), F.lit(False).alias("is_toxic"))
    targets = np.stack([poor, toxic, toxic * poor], 1)
    named, counts = counted_terms(sample, targets, fold)
    position = {t: i for i, t in enumerate(named)}
    sets: list[set[str]] = []
    for r in sample.select("doc_id", F.array_intersect("terms", F.array(*map(F.lit, named)).cast("array<string>")).alias("terms")).orderBy("doc_id").collect():
        sets.append({named[position[t]] for t in r["terms"]})
    shared = spark.sparkContext.broadcast(fit_chain(sets, fold, targets, named, counts))

    def run(batches):
        for b in batches:
            sets = [terms(t) for t in b.column("text").to_pylist()]
            p = np.zeros((len(sets), 0))
            for m in shared.value:
                p = np.column_stack([p, m.predict(sets, p)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(CATEGORIES)))], names=["doc_id", "tag", *(f"p_{c}" for c in CATEGORIES)])

    scored = materialise(doc.mapInArrow(run, "doc_id long, tag long, " + ", ".join(f"p_{c} double" for c in CATEGORIES)), "toxicity")
    bin_ = F.floor(F.col("p_toxic") * bins).cast("int")
    hits, misses = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in scored.join(label, "doc_id").groupBy(bin_.alias("bin"), "toxic").count().collect():
        (hits if r["toxic"] else misses)[r["bin"]] += r["count"]
    found_, wrong = np.cumsum(hits[::-1])[::-1], np.cumsum(misses[::-1])[::-1]
    f1 = 2 * found_ / np.maximum(found_ + wrong + hits.sum(), 1)
    best = np.flatnonzero(f1 == f1.max())
    return scored.withColumn("is_toxic", bin_ >= int(best[len(best) // 2]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

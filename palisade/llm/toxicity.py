"""Toxicity by a chain of linear classifiers.

Method.  Texts become indicators of words and word beginnings.  Their counts among toxic and other labelled texts pick
the ``FEATURES`` with the largest chi-square.  Categories are predicted in order: ``mention`` (a toxic text holds at
least one of the terms most typical of toxic texts), ``repeated`` (three or more) and ``toxic``, the label itself.  Each
has a logistic model on the indicators and on the probabilities of the categories before it.  These probabilities come,
in training, from models that have not seen the row's fold, so that a later model learns from what it will meet.

Labels have one column; the two first categories are derived from it and from the terms learned.  ``fit`` takes any
ordered mapping of categories instead.

Scale.  Scoring is one pass without a shuffle.  At most about ``MAX_TRAIN`` labelled rows (by hash of the id) teach: the
documented bound of the fit, of the ids that are broadcast, and of what the driver solves.

Defined results: null and empty texts have no indicators and get the base rates; null labels are skipped; an id with
several label rows is toxic if one says so; without labels, or with one class, every probability is that class's share.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .decontaminate import words_of

FEATURES, MAX_TRAIN, FOLDS, RIDGE, THRESHOLD = 256, 20_000, 4, 0.3, 0.4
TYPICAL, LEAST_ROWS = 8.0, 3  # log odds that make a term typical; rows a feature must occur in
CHAIN = ("mention", "repeated", "toxic")


def indicators(text: bytes | None) -> set[bytes]:
    """Words, and their first four to six bytes marked as beginnings."""
    words = set(words_of(text))
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in (4, 5, 6)))


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]  # of each category: indicators, earlier probabilities, a constant
    names: tuple[str, ...] = CHAIN

    def encoded(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary) + 1))
        out[:, -1] = 1
        for i, text in enumerate(texts):
            at = [self.vocabulary[w] for w in indicators(text) & self.vocabulary.keys()]
            out[i, at] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each category, each fed to the next."""
        for w in self.weights:
            p = _sigmoid(x @ w)
            x = np.hstack([p[:, None], x])
        return x[:, : len(self.weights)][:, ::-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last column, the constant, is hardly held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + hold * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += hold
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def chained(x: np.ndarray, categories: dict[str, np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's model, earlier categories entering as out-of-fold probabilities."""
    weights = []
    for y in categories.values():
        out = np.zeros(len(x))
        for k in np.unique(fold):
            apart = fold == k
            out[apart] = _sigmoid(x[apart] @ logistic(x[~apart], y[~apart])) if (~apart).any() else y.mean()
        weights.append(logistic(x, y))
        x = np.hstack([out[:, None], x])
    return weights


def sample(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, y)`` of at most about ``max_train`` labelled ids, whatever the table."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    known = materialise(known, "labels")
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    return known


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    known = sample(labels, max_train)
    taught = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    taught = materialise(taught.select("doc_id", "y", "text"), "taught")

    def count(batches):
        tally, sizes = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                tally[y].update(indicators(text.as_py()))
                sizes[y] += 1
        for y in (0, 1):
            items = list(tally[y].items())
            keys = pa.array([k for k, _ in items] + [b""], pa.binary())
            n = np.array([v for _, v in items] + [sizes[y]], np.int64)
            nothing = np.zeros_like(n)
            yield pa.RecordBatch.from_arrays([keys, pa.array(nothing if y else n), pa.array(n if y else nothing)], names=["term", "others", "toxic"])

    counts = taught.mapInArrow(count, "term binary, others long, toxic long").groupBy("term").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts, "terms")
    size = counts.where(F.length("term") == 0).first()
    n0, n1 = (size["others"], size["toxic"]) if size else (0, 0)
    if not n0 or not n1:
        rate = n1 / max(1, n0 + n1)
        constant = np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
        return Chain({}, [np.array([0.0] * k + [constant]) for k in range(len(CHAIN))])
    a, b = F.col("toxic").cast("double"), F.col("others").cast("double")
    n = float(n0 + n1)
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b + 1) * float(n0) * float(n1))
    odds = F.log(((a + 0.1) / (n1 + 0.2)) / ((b + 0.1) / (n0 + 0.2)))
    picked = counts.where(F.length("term") > 0).where(a + b >= LEAST_ROWS).withColumn("chi", chi).withColumn("odds", odds)
    picked = picked.orderBy(F.desc("chi"), "term").limit(FEATURES).collect()
    typical = {bytes(r.term) for r in picked if r.odds > np.log(TYPICAL)}
    chain = Chain({bytes(r.term): i for i, r in enumerate(picked)}, [])
    width = len(picked)

    def encode(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2).cast(pa.large_binary())]
            rows = chain.encoded(texts)[:, :width].astype(np.uint8)
            some = [len(indicators(t) & typical) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(some, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "y", "typical", "x"])

    rows = taught.mapInArrow(encode, "doc_id long, y int, typical int, x binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("x", "ascending")])  # so that reruns agree to the last bit
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint8).reshape(-1, width).astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y, terms, ids = (rows[c].to_numpy() for c in ("y", "typical", "doc_id"))
    categories = {"mention": (y > 0) & (terms >= 1), "repeated": (y > 0) & (terms >= 3), "toxic": y > 0}
    chain.weights = chained(x, {k: v.astype(float) for k, v in categories.items()}, ids % FOLDS)
    return chain


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, mention, repeated, toxic, flagged)``: a probability for each category, and the decision on the last."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.large_binary())]
            p = chain.probabilities(chain.encoded(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T)], names=["doc_id", *CHAIN])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CHAIN))
    return out.withColumn("flagged", (F.col("toxic") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))

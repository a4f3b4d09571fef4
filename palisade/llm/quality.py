"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Method.  Each whole text is reduced to ``len(NAMES)`` statistics.  Standardised, they go through ``DIMS`` random cosine
features, which approximate a Gaussian kernel.  Every partition of the labelled rows sums its share of the normal
equations, per fold; the driver adds the sums and solves.  Leaving one fold's sum out gives out-of-fold scores, whose
binned means are made monotone by pool-adjacent-violators; that curve turns ridge scores into probabilities.

Inputs of a score are the text's statistics alone.  Rows with ``crc32(doc_id) mod 5 = 0`` teach nothing.

Scale.  One pass over the texts leaves ``(doc_id, statistics)``; only that narrow table meets the labels.  Sums sent to
the driver: at most ``SUM_PARTS`` * 4 matrices of ``DIMS`` squared, whatever the corpus.  At most ``MAX_TRAIN`` labelled
rows (by hash of the id) teach; this is the documented bound of the fit.

Defined results: null and empty texts have the statistics of an empty text; null labels are skipped; a ``doc_id`` with
several label rows counts once for each; without labels every score is 0.5, with one class the share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialise

NAMES = (
    "log_bytes log_words log_lines mean_word long_words lower upper digit space sentence_marks other_marks symbols "
    "pipes exclamations high_bytes entropy distinct_words top_word distinct_lines words_a_line words_a_sentence "
    "marked_words capital_words top_line"
).split()
DIMS, RIDGE, FOLDS, BINS, SEED = 256, 1e-3, 5, 512, 20_240_501
MAX_TRAIN, SUM_PARTS = 200_000, 8

_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"/\\<>[]{}=+_~^`@", b"#$%&*", b"|", b"!")):
    _CLASS[list(_chars), _i] = 1


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of a UTF-8 text, in the order of ``NAMES``."""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    shares = counts @ _CLASS / n
    seen = counts[counts > 0] / n
    out[0], out[1], out[2] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines))
    out[5:15] = [*shares, counts[128:].sum() / n]
    out[15] = -(seen * np.log2(seen)).sum()
    if words:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        out[3], out[4] = min(lengths.mean(), 40), (lengths > 12).mean()
        out[16], out[17] = len(tally) / len(words), max(tally.values()) / len(words)
        different = set(lines)
        out[18], out[23] = len(different) / len(lines), (len(lines) - len(different)) / len(lines)
        out[19], out[20] = np.log1p(len(words) / len(lines)), np.log1p(len(words) / (1 + counts[ord(".")]))
        marks = counts[list(b"#$%&*|!")].sum()
        out[21], out[22] = marks / len(words), counts[65:91].sum() / len(words)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats array<float>)`` of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.concatenate([statistics(t.as_py()) for t in texts] or [np.zeros(0, np.float32)])
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<float>")


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the cosine features, and a constant
    knots: np.ndarray  # ridge scores, rising
    values: np.ndarray  # probabilities there, not falling
    dims: int = DIMS
    seed: int = SEED

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosine features of standardised statistics, and a constant."""
        rng, d = np.random.default_rng(self.seed), stats.shape[1]
        turn, shift = rng.normal(0, 1 / np.sqrt(d), (d, self.dims)), rng.uniform(0, 2 * np.pi, self.dims)
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / self.dims) * np.cos(z @ turn + shift), np.ones((len(z), 1))])

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrated(self.features(stats) @ self.weights)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit of a sequence that does not fall (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(NAMES)))


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled rows; ``stats`` as :func:`measured` gives it."""
    known = labels.where(f"{target} is not null and doc_id is not null").select(F.col("doc_id").cast("long"), (F.col(target) > 0).cast("double").alias("y"))
    known = known.where(remainder() != 0)
    n = known.count()
    if n > max_train:  # a bounded sample: the rows whose hash falls below the share
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    train = stats.join(known, "doc_id").select("stats", "y", remainder().cast("int").alias("fold"))
    train = materialise(train, "train").coalesce(SUM_PARTS)

    def moments(frames):
        total = np.zeros((3, len(NAMES)))
        for f in frames:
            x = _stack(f["stats"])
            total += [np.full(len(NAMES), len(x)), x.sum(axis=0), (x**2).sum(axis=0)]
        yield _pandas({"kind": [0], "data": [total.tobytes()]})

    rows = train.mapInPandas(moments, "kind int, data binary").collect()
    total = sum((np.frombuffer(r.data).reshape(3, -1) for r in rows), np.zeros((3, len(NAMES))))
    if not total[0, 0]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(DIMS + 1), np.zeros(1), np.full(1, 0.5))
    mean = total[1] / total[0]
    scale = np.sqrt(np.maximum(total[2] / total[0] - mean**2, 0))
    base = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(DIMS + 1), np.zeros(1), np.zeros(1))
    width = DIMS + 1

    def equations(frames):
        sums = {}
        for f in frames:
            z, y, fold = base.features(_stack(f["stats"])), f["y"].to_numpy(), f["fold"].to_numpy()
            for k in np.unique(fold):
                a, b = sums.get(k, (0, 0))
                part = z[fold == k]
                sums[k] = a + part.T @ part, b + part.T @ y[fold == k]
        yield _pandas({"kind": [int(k) for k in sums], "data": [np.vstack([a, b]).tobytes() for a, b in sums.values()]})

    parts = [np.zeros((width + 1, width)) for _ in range(FOLDS)]
    for r in train.mapInPandas(equations, "kind int, data binary").collect():
        parts[r.kind] += np.frombuffer(r.data).reshape(width + 1, width)

    def solved(total: np.ndarray) -> np.ndarray:
        a, b = total[:-1], total[-1]
        return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(width) * 0.01 + 1e-6 * np.eye(width), b)

    whole = sum(parts)
    base.weights = solved(whole)
    without = [solved(whole - p) if (whole - p)[-2, -1] > 0 else base.weights for p in parts]
    low, high = -0.5, 1.5

    def binned(frames):
        sums = np.zeros((2, BINS))
        for f in frames:
            z, fold = base.features(_stack(f["stats"])), f["fold"].to_numpy()
            raw = np.zeros(len(z))
            for k in np.unique(fold):
                raw[fold == k] = z[fold == k] @ without[k]
            at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
            sums += [np.bincount(at, minlength=BINS), np.bincount(at, f["y"].to_numpy(), minlength=BINS)]
        yield _pandas({"kind": [0], "data": [sums.tobytes()]})

    sums = sum(np.frombuffer(r.data).reshape(2, BINS) for r in train.mapInPandas(binned, "kind int, data binary").collect())
    full = sums[0] > 0
    centres = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    base.knots, base.values = centres[full], monotone(sums[1][full] / sums[0][full], sums[0][full])
    return base


def _pandas(columns: dict):
    import pandas as pd

    return pd.DataFrame(columns)


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` from measured statistics."""

    def run(frames):
        for f in frames:
            yield f[["doc_id"]].assign(score=model.probability(_stack(f["stats"])))

    out = stats.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", (F.coalesce(remainder(), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    stats = materialise(measured(docs), "stats")
    return scored(stats, fit(stats, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the classifier accepts."""
    model = fit(materialise(measured(docs), "stats"), labels)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.large_binary())
            stats = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(NAMES)).astype(float)
            yield batch.filter(pa.array(model.probability(stats) >= threshold)).rename_columns(names)

    return map_batches(docs, run, T.StructType(docs.schema.fields))

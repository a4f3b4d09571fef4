import os

import numpy as np
import pytest

from palisade.llm import quality

SF = "/root/testdata/sf0.1"


def test_monotone_fit_is_the_least_squares_one():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, w = rng.normal(size=8), rng.uniform(0.5, 2, 8)
        fit = quality.monotone(v, w)
        assert (np.diff(fit) >= -1e-12).all()
        for _ in range(200):  # no monotone sequence nearby is better
            other = np.sort(fit + rng.normal(scale=0.2, size=8))
            assert (w * (other - v) ** 2).sum() >= (w * (fit - v) ** 2).sum() - 1e-9


def test_statistics_of_odd_texts():
    assert not quality.statistics(None).any() and not quality.statistics(b"").any()
    for text in (b" \n\t", b"|", "é".encode() * 5, b"x" * 300_000, b"a b\n" * 5000):
        assert np.isfinite(quality.statistics(text)).all()


def test_random_features_approximate_the_kernel():
    n = len(quality.NAMES)
    m = quality.Model(np.zeros(n), np.ones(n), np.zeros(4097), np.zeros(1), np.zeros(1), dims=4096)
    x = np.random.default_rng(1).normal(size=(20, n))
    z = m.features(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * n))
    assert np.abs(z @ z.T - true).max() < 0.08


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 700 and (held.predicted == held.quality).mean() > 0.98
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_defined_cases(spark):
    rows = [(i, "good words in a row. " * (3 + i % 7), 7) for i in range(60)] + [(100 + i, "### $$$ !!! " * (4 + i % 9), 7) for i in range(60)]
    rows += [(500, None, 1), (501, "", 1), (None, "no id", 1), (5, rows[5][1], 7), (502, "word " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, None) for i in range(60)] + [(100 + i, 0, 1) for i in range(60)] + [(None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.predicted for r in found if r.doc_id is not None and r.doc_id < 60} == {1} and {r.predicted for r in found if r.doc_id and 100 <= r.doc_id < 160} == {0}
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.where("false")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert all(r.score > 0.9 for r in quality.classify(docs, labels.where("quality = 1")).collect())
    assert quality.classify(docs.where("false"), labels).count() == 0

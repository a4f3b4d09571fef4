import os

import numpy as np
import pytest

from palisade.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_logistic_regression_is_at_the_optimum():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 3)), np.ones((200, 1))])
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    w = toxicity.logistic(x, y)
    hold = np.array([toxicity.RIDGE] * 3 + [1e-3])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + hold * w
    assert np.abs(slope).max() < 1e-3


def test_later_models_get_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(120, 2)), np.ones((120, 1))])
    y = (x[:, 0] > 0).astype(float)
    fold = np.arange(120) % 4
    weights = toxicity.chained(x, {"a": y, "b": 1 - y}, fold)
    assert [len(w) for w in weights] == [3, 4]
    out = np.zeros(120)
    for k in range(4):
        out[fold == k] = 1 / (1 + np.exp(-x[fold == k] @ toxicity.logistic(x[fold != k], y[fold != k])))
    assert np.allclose(weights[1], toxicity.logistic(np.hstack([out[:, None], x]), 1 - y), atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_accuracy_on_rows_that_taught_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.where("doc_id % 3 <> 0")
    found = toxicity.classify(docs, taught).toPandas().merge(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label").toPandas(), on="doc_id")
    assert len(found) > 1000 and (found.flagged == found.label).mean() > 0.97
    assert found[found.label == 0].flagged.mean() < 0.01


def test_defined_cases(spark):
    rows = [(i, f"nice words {i} here", 3) for i in range(80)] + [(100 + i, f"you nasty awful thing {i}", 3) for i in range(40)]
    rows += [(500, None, 1), (501, "", 1), (None, "nasty awful", 1), (5, rows[5][1], 3), (502, "nice " * 60_000 + " nasty awful", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(100 + i, 1, 1) for i in range(40)] + [(1, 0, None), (None, 1, 1), (100, 1, 0)], "doc_id long, quality int, toxic int")
    found = {(r.doc_id, r.flagged) for r in toxicity.classify(docs, labels).collect()}
    assert {f for i, f in found if i is not None and i < 80} == {0} and {f for i, f in found if i and 100 <= i < 200} == {1}
    assert (None, 1) in found and (500, 0) in found and (501, 0) in found and (502, 1) in found
    assert toxicity.classify(docs, labels).count() == len(rows)
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert all(r.flagged == 0 for r in toxicity.classify(docs, few).collect())
    assert toxicity.classify(docs.where("false"), labels).count() == 0

import os

import pytest

import corpus_pipeline
from palisade.llm import decontaminate, pii, quality, registry
from palisade.llm.common import table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixture"]
    assert set(registry.QUERIES) >= {"pipeline"} and sum(n.startswith("op") for n in registry.QUERIES) == 10


def test_each_stage_against_its_operator(spark, tmp_path):
    docs, seen = table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "mixture":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = seen[-1][1]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = {r.doc_id for r in quality.classify(seen[0][0], table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert ids(seen[0][1]) == good
    from palisade.llm import simhash

    assert ids(seen[1][1]) == {r.component_id for r in simhash.digest(seen[1][0]).collect()}
    assert ids(seen[2][1]) == ids(seen[2][0]) - ids(decontaminate.contaminated(seen[2][0], table(spark, SF, "benchmark")))
    assert seen[3][1].exceptAll(pii.pseudonymised(seen[3][0], pii.DEMO_KEY)).count() == 0 and seen[3][1].count() == seen[3][0].count()
    assert set(seen[4][1].columns) >= {"shard", "slot", "source", "block", "doc_ids", "text"}
    words = sum(len(r.text.encode().split()) for r in seen[4][0].collect())
    assert abs(sum(len(r.text.split(" ")) for r in seen[4][1].collect()) - words) < 0.02 * words

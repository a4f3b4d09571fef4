import random

from palisade.operators import cluster


def test_large_inputs_are_grouped_as_small_ones(spark, monkeypatch):
    rnd = random.Random(2)
    rows = []
    for _ in range(6):  # windows along a sequence: components chain what greedy keeps apart
        line = "".join(rnd.choice("ACGT") for _ in range(120))
        rows += [line[k : k + 30] for k in range(0, 90, 7)]
    rows.append("ACGT")
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "variant string, ord long")

    def groups():
        found = cluster.grouped(frame).toPandas()
        return sorted(sorted(g) for _, g in found.groupby("gid")["variant"])

    small = groups()
    monkeypatch.setattr(cluster, "MAX_GREEDY", 0)
    assert groups() == small and len(small) > 7

import math
import random

import numpy as np

from palisade.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 0.0) for r in rows], SCHEMA).repartition(parts)


def slow(rows, k=5, every=50):
    """Brute force by the stated rules."""
    good = [(i, list(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        a = min(v for i, v in good if i == q)
        best: dict = {}
        for i, b in good:
            if i != q and len(a) == len(b):
                s = dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
                best[i] = max(best.get(i, -9.0), s)
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(n, dims=16, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [f32(c + rnd.gauss(0, 0.3)) for c in centres[i % 6]]) for i in range(n)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_against_brute_force(spark):
    rows = vectors(600)
    same(found(N.digest(table(spark, rows))), slow(rows))


def test_query_blocks(spark):
    rows = vectors(600, seed=2)
    t = table(spark, rows)
    same(found(N.nearest(t, t.where("vec_id % 50 = 0"), block=4)), slow(rows))


def test_defined_cases(spark):
    rows = vectors(120, dims=4)
    rows += [(7, rows[9][1]), (7, rows[7][1]), (50, rows[50][1]), (50, rows[3][1]), (50, [0.0] * 4), (50, [None, 1.0, 1.0, 1.0]), (50, [float('-inf')] * 4), (50, None)]  # repeated ids
    rows += [(200 + i, rows[0][1]) for i in range(9)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan"), 1.0, 0.0, 0.0]), (305, [float("inf"), 1.0, 0.0, 0.0]), (None, rows[1][1]), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, [1e-30, 0.0, 0.0, 0.0])]
    same(found(N.digest(table(spark, rows))), slow(rows))


def test_few_candidates_and_empty(spark):
    rows = vectors(3)
    same(found(N.digest(table(spark, rows, 1))), slow(rows))
    assert N.digest(table(spark, rows).where("false")).count() == 0
    assert N.digest(table(spark, [(50, [1.0, 0.0])], 1)).count() == 0


def test_one_vector_makes_up_a_third_of_all(spark):
    rows = vectors(200) + [(1000 + i, vectors(1)[0][1]) for i in range(100)] + [(5, vectors(6)[5][1])] * 100
    same(found(N.digest(table(spark, rows))), slow(rows))


def test_vectors_of_extreme_size_have_a_cosine(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [-1e-310, 1e-310]), (4, [2.0**1000, 0.0])]
    got = N.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4, 3]
    assert [round(r.score, 12) for r in got] == [1.0, round(0.5**0.5, 12), round(0.5**0.5, 12), 0.0]


def test_scaling_changes_no_digit():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(200, 33)) * 3, rng.normal(size=(200, 33)) * 700
    plain = N._dot(a, b) / (np.sqrt(N._dot(a, a)) * np.sqrt(N._dot(b, b)))
    assert np.array_equal(N.cosine(a, b), plain)

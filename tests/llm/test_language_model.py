import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from palisade.llm import language_model as L


def made(n=120, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 60))).upper() if i % 9 == 0 else " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 60)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, " \n "), (None, "w1 w2 unheard"), (3, "w1 w1"), (3, "w1 w1"), (503, "w0 " * 50_000 + "é\x85x")]


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def slow(rows):
    """Brute force: every count in a dictionary."""
    words = lambda t: (t or "").encode().lower().split() + [b""]
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if learns(i):
            w = words(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
    total, types = sum(uni.values()), len(uni)
    after, context = Counter(b for _, b in bi), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in bi.items():
        context[a][0] += n
        context[a][min(n, 3)] += 1
    d = lambda values: L._discounts(np.array([sum(v == k for v in values) for k in (1, 2, 3, 4)]))
    d2, d1 = d(list(bi.values())), d(list(after.values()))
    n = sum(after.values())
    rest = sum(d1[min(v, 3)] for v in after.values()) / n if n else 1.0
    low = lambda w: ((after[w] - d1[min(after[w], 3)]) / n if after[w] else 0) + rest / (types + 1)

    def p(a, b):
        if a not in context:
            return low(b)
        c, hit = context[a], bi[a, b]
        return ((hit - d2[min(hit, 3)]) / c[0] if hit else 0) + sum(d2[k] * c[k] for k in (1, 2, 3)) / c[0] * low(b)

    for i, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        yield i, not learns(i), len(w), sum(uni[x] > 0 for x in w), total, base, sum(math.log10(p(a, b)) for a, b in zip([None, *w], w))


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = sorted(map(tuple, L.digest(docs).collect()), key=repr)
    want = sorted(slow(rows), key=repr)
    assert len(found) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for f, w in zip(sorted(found, key=key), sorted(want, key=key)):
        assert f[:5] == w[:5] and f[5] == pytest.approx(w[5], rel=1e-9) and f[6] == pytest.approx(w[6], rel=1e-5), (f, w)


def test_against_brute_force(spark):
    check(spark, made())


def test_many_files_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "DOCS_A_FILE", 10)
    monkeypatch.setattr(L, "WORDS_A_FILE", 500)
    rows = [r for r in made(seed=2) if r[0] != 503]
    check(spark, rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(made()[:100], "doc_id long, text string")
    scorer = L.Scorer(L.train(docs))
    words = sorted({w for t in made()[:100] for w in L.tokens((t[1] or "").encode())})
    lower = scorer.word_probability(scorer.reader.numbers(L._hashes(words))[0])
    unknown = scorer.word_probability(np.array([-1]))[0]
    assert lower.sum() + unknown == pytest.approx(1, abs=1e-9)
    for first in (b"w0", b"w5"):
        scores = scorer.score([[first, w] for w in words] + [[first, b"unheard"]])[3]
        alone = scorer.score([[first]])[3][0]
        assert (10 ** (scores - alone)).sum() == pytest.approx(1, abs=1e-5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.digest(none).count() == 0
    held = next(i for i in range(99) if not learns(i))
    row = L.digest(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)

import random

import numpy as np
import pytest
import xxhash

from palisade.llm import simhash


def slow(text, width=3):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [(i, slow(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    low = {}
    for (i, _), g in zip(prints, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return sorted(((i, format(p, "016x"), low.get(g)) for (i, p), g in zip(prints, group)), key=repr)


def texts(seed=3):
    rnd = random.Random(seed)
    words = ["w%d" % rnd.randrange(500) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = rnd.sample(words, 300)
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(300)] = "x%d" % rnd.randrange(9)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "ONE"), (904, "one"), (905, "one two"), (906, "a b c"), (907, "z " * 70_000), (900, None), (None, "one two"), (None, "lonely words here now")]


def test_fingerprints_and_components(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    for tile in (simhash.TILE, 3):
        found = simhash.near_duplicates(docs, tile=tile).collect()
        got = sorted(((r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found), key=repr)
        assert got == expected(rows)


def test_finer_cells_give_the_same_links(spark, monkeypatch):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "FINER", 0)
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found), key=repr) == expected(rows)
    assert (len(simhash._steps(4, 2)), len(simhash._steps(8, 2))) == (21, 73)


def test_one_of_each_group_stays(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "a.b") for i, t in rows], ["doc_id", "text", "a.b"]).repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    roots = {c for _, _, c in expected(rows) if c is not None}
    assert [i for i in ids if i is not None] == sorted(roots) and ids.count(None) == 1


def test_thinned_links_connect_as_much():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    many = np.unique(np.concatenate([base[k % 4] ^ (np.uint64(1) << rng.integers(0, 62, 50, dtype=np.uint64)) for k in range(8)]))
    a, b = simhash.forest(many, many, 2)
    assert len(a) <= 2 * len(many)

    def parts(links):
        group = {int(x): int(x) for x in many}
        for x, y in links:
            old, new = group[int(x)], group[int(y)]
            if old != new:
                group = {k: new if g == old else g for k, g in group.items()}
        return sorted(sorted(k for k in group if group[k] == g) for g in set(group.values()))

    every = [(x, y) for x in many for y in many if int(x ^ y).bit_count() <= 2]
    assert parts(zip(a, b)) == parts(every)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.digest(docs).count() == 0 and simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("text", ["a b", "A  b\x0bC\x85d é", "x " * 5000])
def test_kernel(text):
    assert simhash.fingerprint(text.encode()) == slow(text)


def test_repeated_ids_of_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, a + " x y z " + b), (9, b)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [(3, a), (7, b), (9, a + " x y z " + b)]

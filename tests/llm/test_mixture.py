import random
from collections import Counter

import numpy as np

from palisade.llm import mixture as M


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copy int")


def made(seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        source = rnd.choice(["b", "a", "ü", None, "c", "a", "a"])
        rows.append((i, " ".join(f"{i}_{k}" for k in range(rnd.choice([0, 3, 40, 900]))), source, 9, 9))
    return rows


def slow_targets(sizes):
    weights = M.repeating_weights(sizes)
    left, out, total = set(s for s in sizes if sizes[s]), dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    for _ in range(100):
        share = {s: total * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
        total -= sum(out[s] for s in over)
        left -= over
    raise AssertionError


def test_weights_and_targets():
    assert M.repeating_weights([None, "b", "a", "ü", "z"]) == {"a": 1, "b": 2, "z": 3, "ü": 1, None: 2}
    rnd = random.Random(2)
    for _ in range(50):
        sizes = {f"s{k}": rnd.choice([0, 1, 10, 1000]) for k in range(rnd.randrange(1, 7))}
        got = M.targets(sizes, M.repeating_weights(sizes))
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 or all(got[s] == 3 * sizes[s] for s in sizes if sizes[s])


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = M.permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
    assert M.permuted(np.arange(1000), 1000, 5).tolist() != M.permuted(np.arange(1000), 1000, 6).tolist()


def test_words_taken(spark):
    rows = made() + [(900, None, "a", 0, 0), (901, "", None, 0, 0), (902, "x " * 60_000, "b", 0, 0), (3, "same words", "a", 0, 0), (3, "same words", "a", 0, 0), (None, "no id here", "c", 0, 0)]
    docs = docs_of(spark, rows).repartition(3)
    out = M.taken(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for i, t, s, *_ in rows:
        size[s] += len((t or "").split())
    target = slow_targets(dict(size))
    got = Counter()
    by_id = {}
    for i, t, s, *_ in rows:
        by_id.setdefault(i, []).append((len((t or "").split()), s))
    for r in out:
        assert r.taken <= 3 * r["size"]
        source = next(s for n, s in by_id[r.doc_id] if n == r["size"])
        assert r.source_size == size[source] and abs(r.target - target[source]) < 1e-6
        got[source] += r.taken
    for s in target:
        assert abs(got[s] - target[s]) <= max(3, 0.03 * target[s]), s
    again = M.taken(docs_of(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_blocks_hold_the_words_taken(spark):
    rows = made(3)
    rows.append(rows[5])
    docs = docs_of(spark, rows)
    taken = Counter()
    for r in M.taken(docs).collect():
        taken[r.doc_id] += r.taken
    mix = M.mixed(docs).collect()
    words = Counter()
    for r in mix:
        for w in r.text.split(" "):
            words[int(w.split("_")[0])] += 1
            assert int(w.split("_")[0]) in r.doc_ids
    assert words == +taken
    assert len({(r.shard, r.source, r.slot) for r in mix}) == len(mix)
    slots = Counter(r.shard for r in mix)
    assert max(slots.values()) - min(slots.values()) <= 1
    whole = {(r.source, r.block): r.text for r in mix}
    assert all(whole[r.source, r.block] == r.text for r in mix)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert M.taken(none).count() == 0 and M.mixed(none).count() == 0
    blank = docs_of(spark, [(1, "", "a", 0, 0), (2, None, None, 0, 0)])
    assert [(r.doc_id, r["size"], r.target, r.taken) for r in M.taken(blank).orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert M.mixed(blank).count() == 0

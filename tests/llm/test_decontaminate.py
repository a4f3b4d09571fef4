import random

import numpy as np

from palisade.llm import decontaminate as D


def made(seed=4):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    words = lambda n: rnd.choices(vocabulary, weights, k=n)
    items = [words(rnd.randrange(15, 60)) for _ in range(40)]
    docs, true = [], set()
    for i in range(300):
        body = words(rnd.randrange(5, 700))
        if i % 5 == 0:
            k = rnd.randrange(40)
            piece = list(items[k])
            if i % 10 == 0:  # a paraphrase: every eighth word another
                piece[::8] = words(len(piece[::8]))
            at = rnd.randrange(len(body))
            body[at:at] = piece
            true.add((i, k))
        docs.append((i, " ".join(body)))
    return [(k, " ".join(w[:10]) + ".\n" + " ".join(w[10:])) for k, w in enumerate(items)], docs, true


def test_planted_passages_are_found_and_nothing_else(spark):
    items, docs, true = made()
    long = ("filler " * 90_000 + items[3][1] + " filler" * 10_000).upper()
    rows = [(i, t, 0.5, 1) for i, t in docs] + [(900, None, 0.0, 1), (901, "", 0.0, 1), (902, long, 0.0, 1), (None, items[4][1], 0.0, 1), (0, docs[0][1], 0.5, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cosine double, item_id int")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (93, "qq zz yy xx vv")], "item_id long, text string")
    found = D.contaminated(frame, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == true | {(902, 3), (None, 4)}
    kept = D.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {a for a, _ in got}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert D.contaminated(docs, bench.where("false")).count() == 0 and D.contaminated(docs.where("false"), bench).count() == 0
    assert D.keep_clean(docs, bench.where("false")).count() == 1


def test_short_items_match_word_for_word(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha beta, gamma delta epsilon y"), (2, "alpha beta gamma epsilon delta")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.word_at) for r in D.contaminated(docs, bench).collect()] == [(1, 1, 1)]


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    items, docs, true = made()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "item_blocks", lambda b: _blocks(b, 20))
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()} == true


def _blocks(bench, size):
    rows = [(r.item_id, r.text) for r in bench.collect()]
    return [D.Items(rows[k : k + size]) for k in range(0, len(rows), size)]


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = [rnd.randrange(4) for _ in range(rnd.randrange(1, 12))], [rnd.randrange(4) for _ in range(rnd.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert D.common_subsequence(D.positions(a), len(a), b) == table[-1, -1]


def test_item_that_a_third_of_the_rows_hold(spark):
    items, docs, _ = made()
    rnd = random.Random(8)
    words = [w for _, text in docs for w in text.split()]
    copy, rows = items[0][1].replace(".", "").split(), []
    for i in range(3000):
        body = rnd.choices(words, k=20)
        body[10:10] = copy if i % 3 == 0 else []
        rows.append((i, " ".join(body)))
    found = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(i, 0) for i in range(0, 3000, 3)}


def test_exact_copies_of_long_items(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    items = [(k, " ".join(rnd.choices(vocabulary, weights, k=n))) for k, n in enumerate([300, 600, 800, 1000] * 6)]
    docs = [(k, " ".join([*rnd.choices(vocabulary, weights, k=rnd.randrange(40)), text, *rnd.choices(vocabulary, weights, k=40)])) for k, text in items]
    docs += [(100 + k, " ".join(rnd.choices(vocabulary, weights, k=400))) for k in range(100)]
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(k, k) for k, _ in items} <= got and all(d < 100 for d, _ in got)


def test_items_of_any_length_are_found_whole_or_paraphrased(spark):
    """Copies, and paraphrases that the exhaustive rule of the longest common subsequence takes, of items of 10 to 2,000 words."""
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    weights = [1 / (k + 3) for k in range(len(vocabulary))]
    words = lambda n: rnd.choices(vocabulary, weights, k=n)
    items = [words(n) for n in (10, 20, 40, 100, 200, 400, 800, 1200, 2000) for _ in range(6)]
    docs = [(1000 + i, " ".join(words(400))) for i in range(300)]
    want = set()
    for k, item in enumerate(items):
        for kind in (0, 1):
            piece = list(item)
            if kind:
                places = range(k % 7, len(piece), 7)
                for p, w in zip(places, words(len(places))):
                    piece[p] = w
            body = words(rnd.randrange(0, 90)) + piece + words(rnd.randrange(0, 90))
            docs.append((2 * k + kind, " ".join(body)))
            want.add((2 * k + kind, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert {x for x in want if x[0] % 2 == 0} <= found
    assert len(want & found) >= 0.97 * len(want) and not {x for x in found if x[0] >= 1000}


def test_blocks_are_bounded_by_words_too(spark):
    bench = spark.createDataFrame([(k, "a b c d " * (1 + 9 * k)) for k in range(8)], "item_id long, text string").coalesce(1)
    blocks = list(D.item_blocks(bench, size=3, most=100))
    assert sorted(k for b in blocks for k in b.keys) == list(range(8)) and max(len(b.keys) for b in blocks) <= 3
    assert all(len(b.keys) == 1 or sum(map(len, b.words)) <= 100 for b in blocks)

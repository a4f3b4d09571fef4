import random
from collections import defaultdict

from palisade.operators import clean, graph


def _by_hand(edges, reads):
    ahead = [(f, a, b) for f, a, b, kind in edges if kind in ("F", "JF")]
    after = defaultdict(set)
    for f, a, b in ahead:
        after[f, a].add(b)
    cover = defaultdict(int)
    for f, _, held in reads:
        for n in held:
            cover[f, n] += bool(after[f, n] & set(held))
    between = defaultdict(list)
    for f, a, b in ahead:
        for g, c, d in ahead:
            if (f, b) == (g, c) and a != d:
                between[f, a, d].append(b)
    lost = set()
    for (f, _, _), nodes in between.items():
        best = max(nodes, key=lambda n: (cover[f, n], n))
        nodes.remove(best)
        lost |= {(f, n) for n in nodes}
    return {k: v for k, v in cover.items() if v}, lost


def test_node_bubbles_and_coverage_against_brute_force(spark):
    draw = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(f, draw.choice(names), draw.choice(names), draw.choice(["F", "B", "JF", "JB"])) for f in range(4) for _ in range(30)})
    reads = [(draw.randrange(4), i, draw.sample(names, draw.randint(1, 5))) for i in range(60)]
    cover, lost = _by_hand(edges, reads)
    e = spark.createDataFrame(edges, "family int, src string, dst string, etype string")
    r = spark.createDataFrame(reads, "family int, read_id long, nodes array<string>")
    assert {(x.family, x.node): x.discounted for x in graph.discounted_coverage(e, r).collect()} == cover
    assert lost and sorted((x.family, x.node) for x in clean.node_bubbles(e, r).collect()) == sorted(lost)
    assert clean.node_bubbles(e.limit(0), r).count() == 0

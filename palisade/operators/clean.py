"""Cleaning of graphs, contigs and flankers.

Graphs are edge tables keyed by group; every rule is a join or an aggregate over all groups at once, and rules that go on
until nothing changes loop over rounds that are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import FLANKER_DEVIATIONS, MAX_SPACER_DEVIATION
from . import graph
from .durable import components, discard, numbered, written

NEIGHBOURS_AT_ONCE = 1024  # neighbours after a spacer that meet those before it in one key of a join


# node graph


def stray_caps(edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(family, node)``: caps (rank 1) to detach.  One that hangs on a jumping edge goes if its neighbour's rank isn't
    2.  One on an inner edge at a cross goes too, but where all of the cross's neighbours over such edges are caps, the
    best covered one stays (of equal ones the smallest)."""
    rank = graph.ranks(edges)
    caps = edges.join(rank.where("total_rank = 1").select("family", F.col("node").alias("src")), ["family", "src"])
    near = caps.join(rank.select("family", F.col("node").alias("dst"), F.col("total_rank").alias("near_rank")), ["family", "dst"])
    jumping = near.where("etype in ('JF', 'JB') and near_rank <> 2").select("family", F.col("src").alias("node"))
    inner = near.where("etype in ('F', 'B') and near_rank > 2").select("family", "dst", F.col("src").alias("node"), "etype")
    back = F.when(F.col("etype") == "F", "B").otherwise("F")
    all_inner = edges.where("etype in ('F', 'B')").groupBy("family", F.col("src").alias("dst"), F.col("etype").alias("way")).agg(F.count("*").alias("arms"))
    counted = inner.withColumn("way", back).join(coverage.select("family", "node", "coverage"), ["family", "node"])
    fork = counted.join(counted.groupBy("family", "dst", "way").agg(F.count("*").alias("caps")), ["family", "dst", "way"]).join(all_inner, ["family", "dst", "way"])
    best = F.row_number().over(W.partitionBy("family", "dst", "way").orderBy(F.desc("coverage"), "node"))
    lost = fork.withColumn("place", best).where("not (caps = arms and caps > 1 and place = 1)")
    return jumping.unionByName(lost.select("family", "node")).distinct()


def caps_at(edges: DataFrame, strict: bool = False) -> DataFrame:
    """``(family, node, caps)``: how many neighbours of each node are caps (rank 1); ``strict`` leaves out nodes that have
    other neighbours too."""
    rank = graph.ranks(edges).select("family", F.col("node").alias("dst"), (F.col("total_rank") == 1).alias("cap"))
    out = edges.join(rank, ["family", "dst"]).groupBy("family", F.col("src").alias("node")).agg(F.count_if("cap").alias("caps"), F.bool_and("cap").alias("only"))
    return out.where("only" if strict else "caps > 0").select("family", "node", "caps")


def one_sided(edges: DataFrame) -> DataFrame:
    """``(family, node)``: nodes of rank 2 without one inner and one jumping edge."""
    return graph.ranks(edges).where("total_rank = 2 and inner_rank <> 1").select("family", "node")


def node_bubbles(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """``(family, node)``: of nodes on parallel two-step paths between the same ends all but the best by discounted
    coverage; of equal ones the last in order stays.

    Nodes of a family (as many at most as there are k-mers) are placed from the best on, so that the best between two ends
    is a minimum, added up before the shuffle.  A node is lost if it lies between two ends more often than it is the best
    there.
    """
    ahead = edges.where("etype in ('F', 'JF')").select("family", "src", "dst")
    nodes = ahead.select("family", F.explode(F.array("src", "dst")).alias("node")).distinct()
    best_first = W.partitionBy("family").orderBy(F.coalesce("discounted", F.lit(0)).desc(), F.desc("node"))
    placed = nodes.join(graph.discounted_coverage(edges, reads), ["family", "node"], "left").select("family", "node", F.row_number().over(best_first).alias("place"))
    placed = written(placed, "places")
    steps = ahead.join(placed.select("family", F.col("node").alias("src"), F.col("place").alias("x")), ["family", "src"])
    steps = written(steps.join(placed.select("family", F.col("node").alias("dst"), F.col("place").alias("y")), ["family", "dst"]).select("family", "x", "y"), "steps")
    paths = steps.select("family", "x", F.col("y").alias("s")).join(steps.select("family", F.col("x").alias("s"), "y"), ["family", "s"]).where("x <> y")
    times = paths.groupBy("family", "s").agg(F.count("*").alias("times"))
    wins = paths.groupBy("family", "x", "y").agg(F.min("s").alias("s")).groupBy("family", "s").agg(F.count("*").alias("wins"))
    lost = times.join(wins, ["family", "s"], "left").where(F.col("times") > F.coalesce("wins", F.lit(0)))
    return placed.join(lost.select("family", F.col("s").alias("place")), ["family", "place"], "left_semi").select("family", "node")


def cleaned_nodes(edges: DataFrame, coverage: DataFrame, reads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Edges after caps, one-sided nodes and bubbles have gone, round by round until none is left."""
    ours = False
    for _ in range(max_rounds):
        rules = (lambda e: stray_caps(e, coverage), one_sided, lambda e: node_bubbles(e, reads))
        changed = False
        for rule in rules:
            gone = written(rule(edges), "gone")
            if gone.limit(1).count():
                left = written(graph.without_nodes(edges, gone), "edges")
                if ours:
                    discard(edges)
                edges, changed, ours = left, True, True
            discard(gone)
        if not changed:
            return edges
    raise RuntimeError("the graph did not settle")


# spacer graph


def _both_ways(edges: DataFrame) -> DataFrame:
    """``(family, a, b, way)``: each edge from both of its spacers, F ahead and R back."""
    a, b = F.concat_ws(":", "src_low", "src_high"), F.concat_ws(":", "dst_low", "dst_high")
    ahead = edges.select("family", a.alias("a"), b.alias("b"), F.lit("F").alias("way"))
    return ahead.unionByName(ahead.select("family", F.col("b").alias("a"), F.col("a").alias("b"), F.lit("R").alias("way")))


def spacer_ranks(edges: DataFrame) -> DataFrame:
    """``(family, spacer, rank, ahead, back)`` of the spacers that have edges."""
    ahead = F.sum((F.col("way") == "F").cast("long"))
    out = _both_ways(edges).groupBy("family", F.col("a").alias("spacer")).agg(F.count("*").alias("rank"), ahead.alias("ahead"))
    return out.withColumn("back", F.col("rank") - F.col("ahead"))


def fur(edges: DataFrame) -> DataFrame:
    """``(family, spacer)``: spacers of rank 1 at a neighbour of rank above 2."""
    rank = spacer_ranks(edges).select("family", "spacer", "rank")
    near = _both_ways(edges).join(rank.where("rank = 1").select("family", F.col("spacer").alias("a")), ["family", "a"])
    return near.join(rank.where("rank > 2").select("family", F.col("spacer").alias("b")), ["family", "b"], "left_semi").select("family", F.col("a").alias("spacer"))


def not_viable(edges: DataFrame) -> DataFrame:
    """``(family, spacer)``: spacers of rank 2 or more whose edges all lead one way."""
    return spacer_ranks(edges).where("rank >= 2 and (ahead = 0 or back = 0)").select("family", "spacer")


def spacer_bubbles(edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(family, spacer)``: of spacers between the same two others, all but the best by coverage, rank and age.  Off by
    default in :func:`cleaned_spacers`.

    Spacers are numbered from the best on, so that the best between two others is a minimum, added up before the shuffle.
    A spacer is lost if it lies between two others more often than it is the best there; how often it lies is the product
    of its neighbours before and after, and paths are gone through once.
    """
    ranked = spacer_ranks(edges).select("family", "spacer", "rank").join(coverage, ["family", "spacer"], "left")
    order = ranked.select("family", "spacer", F.col("coverage").isNotNull().alias("known"), (-F.col("coverage")).alias("cover"), (-F.col("rank")).alias("place"), "ord_read", "ord_idx")
    best_first = numbered(order, "cover", "place", "ord_read", "ord_idx", "family", "spacer").select("family", "spacer", "known", "number")
    best_first = written(best_first, "numbers")
    steps = _both_ways(edges).where("way = 'F'")
    steps = steps.join(best_first.select("family", F.col("spacer").alias("a"), F.col("number").alias("x"), F.col("known").alias("known_x")), ["family", "a"])
    steps = steps.join(best_first.select("family", F.col("spacer").alias("b"), F.col("number").alias("y"), F.col("known").alias("known_y")), ["family", "b"])
    steps = written(steps.select("x", "y", "known_x", "known_y"), "steps")
    before = steps.where("known_y").select(F.col("y").alias("s"), F.col("x").alias("before"))
    after = steps.where("known_x").select(F.col("x").alias("s"), F.col("y").alias("after"))
    times = before.groupBy("s").agg(F.count("*").alias("n_before")).join(after.groupBy("s").agg(F.count("*").alias("n_after")), "s")
    # a spacer with many after it is cut into parts of about so many
    parts = F.ceil(F.col("n_after") / NEIGHBOURS_AT_ONCE).cast("int")
    cut = times.select("s", parts.alias("parts"))
    left = before.join(cut, "s").select("s", "before", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = after.join(cut, "s").select("s", "after", F.pmod(F.xxhash64("after"), F.col("parts")).cast("int").alias("part"))
    paths = left.join(right, ["s", "part"]).select("s", F.least("before", "after").alias("x"), F.greatest("before", "after").alias("y"))
    wins = paths.groupBy("x", "y").agg(F.min("s").alias("s")).groupBy("s").agg(F.count("*").alias("wins"))
    lost = times.join(wins, "s", "left").where(F.col("n_before") * F.col("n_after") > F.coalesce("wins", F.lit(0)))
    return best_first.join(lost.select(F.col("s").alias("number")), "number", "left_semi").select("family", "spacer")


def without_spacers(edges: DataFrame, gone: DataFrame) -> DataFrame:
    a, b = F.concat_ws(":", "src_low", "src_high"), F.concat_ws(":", "dst_low", "dst_high")
    out = edges.withColumn("a", a).withColumn("b", b)
    out = out.join(gone.select("family", F.col("spacer").alias("a")), ["family", "a"], "left_anti")
    return out.join(gone.select("family", F.col("spacer").alias("b")), ["family", "b"], "left_anti").select(*edges.columns)


def cleaned_spacers(edges: DataFrame, coverage: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """Edges after fur and spacers that aren't viable have gone (and bubbles, if ``coverage`` is given), until none is
    left."""
    rules = [fur, not_viable, *([lambda e: spacer_bubbles(e, coverage)] if coverage is not None else [])]
    ours = False
    for _ in range(max_rounds):
        changed = False
        for rule in rules:
            gone = written(rule(edges), "gone")
            if gone.limit(1).count():
                left = written(without_spacers(edges, gone), "edges")
                if ours:
                    discard(edges)
                edges, changed, ours = left, True, True
            discard(gone)
        if not changed:
            return edges
    raise RuntimeError("the graph did not settle")


def contigs(edges: DataFrame) -> DataFrame:
    """``(family, spacer, contig)``: maximal unbranched paths; a spacer of rank above 2 is a contig of its own.  Numbers
    are labels, in the order of the smallest spacer of each."""
    rank = spacer_ranks(edges).select("family", "spacer", "rank")
    plain = rank.where("rank <= 2").select("family", "spacer")
    ways = _both_ways(edges).where("way = 'F'")
    links = ways.join(plain.withColumnRenamed("spacer", "a"), ["family", "a"], "left_semi").join(plain.withColumnRenamed("spacer", "b"), ["family", "b"], "left_semi")
    roots = components(links.select("family", "a", "b"), "family")
    named = rank.join(roots.withColumnRenamed("node", "spacer"), ["family", "spacer"], "left").withColumn("root", F.coalesce("root", "spacer"))
    heads = named.select("family", "root").distinct().withColumn("contig", F.row_number().over(W.partitionBy("family").orderBy("root")))
    return named.join(heads, ["family", "root"]).select("family", "spacer", "contig")


# flankers and groups


def length_statistics(held: DataFrame) -> DataFrame:
    """``(family, n, mean, deviation)`` of spacer lengths: integer mean, deviation around it."""
    n, total, squares = F.count("*"), F.sum(F.length("seq")), F.sum(F.length("seq") * F.length("seq"))
    sums = held.groupBy("family").agg(n.alias("n"), total.alias("total"), squares.alias("squares"))
    mean = F.floor(F.col("total") / F.col("n"))
    out = sums.withColumn("mean", mean)
    return out.select("family", "n", "mean", F.sqrt((F.col("squares") - 2 * F.col("mean") * F.col("total") + F.col("n") * F.col("mean") * F.col("mean")) / F.col("n")).alias("deviation"))


def flankers(held: DataFrame) -> DataFrame:
    """Adds ``flanker``: in groups of three spacers or more whose lengths deviate by more than 1, those outside 1.5
    deviations of the mean (bounds cut to integers)."""
    stats = length_statistics(held)
    low = F.floor(F.col("mean") - FLANKER_DEVIATIONS * F.col("deviation"))
    high = F.floor(F.col("mean") + FLANKER_DEVIATIONS * F.col("deviation"))
    outside = (F.length("seq") < low) | (F.length("seq") > high)
    joined = held.join(stats, "family")
    return joined.withColumn("flanker", (F.col("n") >= 3) & (F.col("deviation") > 1) & outside).drop("n", "mean", "deviation")


def confident(held: DataFrame, min_coverage: int = 3) -> DataFrame:
    """``(family, n, deviation)``: groups with enough spacers that aren't flankers, of lengths alike."""
    return length_statistics(held.where("not flanker")).where((F.col("n") >= min_coverage) & (F.col("deviation") <= MAX_SPACER_DEVIATION)).select("family", "n", "deviation")


def spacer_counts(held: DataFrame) -> DataFrame:
    """``(family, spacers, flankers)``."""
    return held.groupBy("family").agg(F.count_if(~F.col("flanker")).alias("spacers"), F.count_if("flanker").alias("flankers"))


def coverage_limits(held: DataFrame) -> DataFrame:
    return held.groupBy("family").agg(F.min("coverage").alias("low"), F.max("coverage").alias("high"))

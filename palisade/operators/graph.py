"""The k-mer graph of a group's spacers and the spacer graph, as node and edge tables.

All tables carry the group as ``family``.  The order in which things are seen is explicit: ``(read_id, idx)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nodes(given: DataFrame) -> DataFrame:
    """``(family, node, coverage, is_forward)``: occurrences of each k-mer; its direction is that of the first sighting
    (forward: at the start of a spacer, which counts as earlier than its end)."""
    starts = given.where("first is not null").select("family", F.col("first").alias("node"), "read_id", "idx", F.lit(0).alias("side"))
    ends = given.where("last is not null").select("family", F.col("last").alias("node"), "read_id", "idx", F.lit(1).alias("side"))
    both = starts.unionByName(ends)
    seen = F.struct("read_id", "idx", "side")
    return both.groupBy("family", "node").agg(F.count("*").alias("coverage"), (F.min_by("side", seen) == 0).alias("is_forward"))


def read_nodes(given: DataFrame) -> DataFrame:
    """``(family, read_id, nodes)``: the nodes of each read, each once.  Rows of a read lie together where reads are cut,
    so they are combined before the shuffle."""
    both = F.filter(F.array("first", "last"), lambda x: x.isNotNull())
    nodes = given.select("family", "read_id", F.explode(both).alias("node"))
    return nodes.groupBy("family", "read_id").agg(F.collect_set("node").alias("nodes"))


def node_reads(given: DataFrame) -> DataFrame:
    """``(family, node, read_id)``, each once."""
    return read_nodes(given).select("family", F.explode("nodes").alias("node"), "read_id")


def spacers(given: DataFrame) -> DataFrame:
    """``(family, low, high, leader, last, seq, coverage, ord_read, ord_idx)``: spacers by the unordered pair of their end
    nodes; sequence and direction are those of the first sighting, coverage counts all."""
    whole = given.where("first is not null and last is not null")
    keyed = whole.select("family", F.least("first", "last").alias("low"), F.greatest("first", "last").alias("high"), "first", "last", "spacer", "read_id", "idx")
    seen = F.min(F.struct("read_id", "idx", "first", "last", "spacer")).alias("m")
    out = keyed.groupBy("family", "low", "high").agg(seen, F.count("*").alias("coverage"))
    return out.select("family", "low", "high", F.col("m.first").alias("leader"), "m.last", F.col("m.spacer").alias("seq"), "coverage", F.col("m.read_id").alias("ord_read"), F.col("m.idx").alias("ord_idx"))


def inner_edges(held: DataFrame) -> DataFrame:
    """``(family, src, dst, etype)``: F from a spacer's first node to its last, B back."""
    ahead = held.select("family", F.col("leader").alias("src"), F.col("last").alias("dst"), F.lit("F").alias("etype"))
    return ahead.unionByName(ahead.select("family", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("B").alias("etype")))


def jumping_edges(given: DataFrame, held: DataFrame) -> DataFrame:
    """``(family, src, dst, etype)``: JF from the last node of a stretch to the first of the next one in a read, JB back,
    unless a spacer has that pair of ends."""
    ordered = W.partitionBy("read_id").orderBy("idx")
    steps = given.withColumn("src", F.lag("last").over(ordered)).where("src is not null and first is not null").select("family", "src", F.col("first").alias("dst")).distinct()
    keyed = steps.withColumn("low", F.least("src", "dst")).withColumn("high", F.greatest("src", "dst"))
    ahead = keyed.join(held.select("family", "low", "high"), ["family", "low", "high"], "left_anti").select("family", "src", "dst", F.lit("JF").alias("etype"))
    return ahead.unionByName(ahead.select("family", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("JB").alias("etype")))


def ranks(edges: DataFrame) -> DataFrame:
    """``(family, node, inner_rank, jumping_rank, total_rank)``."""
    inner = F.sum(F.col("etype").isin("F", "B").cast("long"))
    return edges.groupBy("family", F.col("src").alias("node")).agg(inner.alias("inner_rank"), (F.count("*") - inner).alias("jumping_rank"), F.count("*").alias("total_rank"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left when nodes ``gone(family, node)`` are detached, at whichever end they lie."""
    out = edges.join(gone.select("family", F.col("node").alias("src")), ["family", "src"], "left_anti")
    return out.join(gone.select("family", F.col("node").alias("dst")), ["family", "dst"], "left_anti").select(*edges.columns)


def discounted_coverage(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """``(family, node, discounted)``: reads of a node that also show at least one other time across its neighbours;
    ``reads`` as :func:`read_nodes` gives them.

    A read goes to each of its nodes once, with all of its nodes beside it, and meets the node's neighbours as one array
    (as many at most as there are k-mers).  The key of that join isn't the one of the sums, so that adaptive execution can
    split a node that many reads hold.  The neighbours, which the graph bounds, are hashed within a partition, so that the
    reads with all their nodes needn't be sorted.
    """
    key = F.concat("src", F.lit("~")).alias("key")
    onward = edges.where("etype in ('F', 'JF')").groupBy("family", "src").agg(F.collect_set("dst").alias("dsts")).select("family", key, "dsts").hint("shuffle_hash")
    own = reads.select("family", "nodes", F.explode("nodes").alias("src"))
    near = own.select("*", key).join(onward, ["family", "key"]).where(F.arrays_overlap("nodes", "dsts"))
    return near.groupBy("family", F.col("src").alias("node")).agg(F.count("*").alias("discounted"))


def spacer_edges(held: DataFrame, jumps: DataFrame) -> DataFrame:
    """``(family, src_low, src_high, dst_low, dst_high)``: one spacer follows another if a jumping edge leads from its
    last node to the other's first."""
    a = held.select("family", F.col("low").alias("src_low"), F.col("high").alias("src_high"), F.col("last").alias("src"))
    b = held.select("family", F.col("low").alias("dst_low"), F.col("high").alias("dst_high"), F.col("leader").alias("dst"))
    ahead = jumps.where("etype = 'JF'").select("family", "src", "dst")
    out = ahead.join(a, ["family", "src"]).join(b, ["family", "dst"])
    return out.where("src_low <> dst_low or src_high <> dst_high").select("family", "src_low", "src_high", "dst_low", "dst_high").distinct()

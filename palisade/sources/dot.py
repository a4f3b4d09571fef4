"""Graphviz text of spacer and node graphs, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def spacer_label(spid, seq, cov, flanker, contig, with_sequence: bool = False) -> Column:
    """``sp_`` or ``fl_``, id, sequence if wanted, coverage and contig."""
    parts = [F.concat(F.when(flanker, "fl_").otherwise("sp_"), spid)]
    if with_sequence:
        parts.append(seq)
    return F.concat_ws("_", *parts, cov.cast("string"), F.concat(F.lit("C"), contig.cast("string")))


def node_lines(spacers: DataFrame, steps: int = 10) -> DataFrame:
    """``(gid, line)`` for ``spacers(gid, spid, seq, cov, flanker, contig, low, high)``: circles, or diamonds for
    flankers, filled by coverage."""
    colour = S.heat_colour("cov", F.col("low"), F.col("high"), F.lit(float(steps)))
    label = spacer_label(F.col("spid"), F.col("seq"), F.col("cov"), F.col("flanker"), F.col("contig"))
    shape = F.when(F.col("flanker"), "diamond").otherwise("circle")
    return spacers.select("gid", F.concat(F.lit("\t"), "spid", F.lit(' [ label = "'), label, F.lit('" shape = '), shape, F.lit(' style = filled fillcolor = "#'), colour, F.lit('" ]')).alias("line"))


def kmer_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gid, line)`` of a k-mer graph: forward nodes are circles, others squares; each edge once, by its kind."""
    shape = F.when(F.col("is_forward"), "circle").otherwise("square")
    points = nodes.select(F.col("family").alias("gid"), F.concat(F.lit("\t"), "node", F.lit(" [ shape = "), shape, F.lit(' label = "'), "node", F.lit("_"), F.col("coverage").cast("string"), F.lit('" ]')).alias("line"))
    ways = edges.where("etype in ('F', 'JF')").select(F.col("family").alias("gid"), F.concat(F.lit("\t"), "src", F.lit(" -> "), "dst", F.when(F.col("etype") == "JF", " [ style = dashed ]").otherwise("")).alias("line"))
    return points.unionByName(ways)


def edge_lines(edges: DataFrame) -> DataFrame:
    """``(gid, line)`` for ``edges(gid, src, dst)``."""
    return edges.select("gid", F.concat(F.lit("\t"), "src", F.lit(" -> "), "dst").alias("line"))


def colour_key(limits: DataFrame, steps: int = 10) -> DataFrame:
    """``(gid, value, colour)``: the scale of each group in ``steps`` equal parts; ``limits(gid, low, high)``."""
    part = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (steps - 1))
    rows = limits.select("gid", "low", "high", F.explode(part).alias("value"))
    return rows.select("gid", F.col("value").cast("double").alias("value"), S.heat_colour("value", F.col("low"), F.col("high"), F.lit(float(steps))).alias("colour"))


def graph_text(nodes: DataFrame, edges: DataFrame, title: str = "spacers") -> DataFrame:
    """``(gid, text)``: a whole graph for each group that has a node."""
    body = nodes.select("gid", F.lit(0).alias("part"), "line").unionByName(edges.select("gid", F.lit(1).alias("part"), "line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])
    held = body.groupBy("gid").agg(F.array_join(lines, "\n").alias("body")).join(nodes.select("gid").distinct(), "gid", "left_semi")
    return held.select("gid", F.concat(F.lit(f'digraph "{title}" {{\n'), "body", F.lit("\n}\n")).alias("text"))

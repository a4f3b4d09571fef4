"""The whole way from reads to groups with statistics, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import clean, cluster, consensus, detect, durable, graph, recruit, spacers
from ..params import Params
from .star import Star, sql


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each repeat family: reads that hold a seed hit, repeats, spacers and lengths."""
    t = Star(spark, sf_dir)
    held = detect.seeded(t.hits).select("read_id", "family", "seq", "repeats")
    per_read = held.groupBy("family").agg(F.count("*").alias("reads"), F.sum(F.size("repeats")).cast("long").alias("repeats"))
    counted = spacers.spacers_of(held).groupBy("family", "spacer").agg(F.count("*").alias("coverage"))
    per_family = counted.groupBy("family").agg(F.count("*").alias("spacers"), stats.int_mean(F.length("spacer")).alias("spacer_length"), stats.int_mean("coverage").alias("coverage"))
    return per_read.join(per_family, "family")


QUERIES = {"group_report": group_report}

def array_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way on reads of which every second one lies on the other strand: a row for each group found."""
    from ..functions import sequence as S

    reads = Star(spark, sf_dir).reads
    turned = F.when(F.col("read_id") % 2 == 1, S.reverse_complement("seq")).otherwise(F.col("seq"))
    # the reads are gone through three times and dear to put together
    found = find_arrays(durable.written(reads.select("read_id", turned.alias("seq")), "reads"))
    n = found["spacers"].groupBy(F.col("family").alias("gid")).agg(F.count("*").alias("spacers"), F.sum("coverage").alias("coverage"), F.count_if("flanker").alias("flankers"))
    return found["groups"].select("gid", "true_dr").join(n, "gid")


QUERIES["array_groups"] = array_groups
ORACLES = {
    "group_report": sql(
        """select r.family, r.reads, r.repeats, s.spacers, s.spacer_length, s.coverage from (select family, count(*) as reads, cast(sum(n_spacers + 1) as bigint) as repeats from reads where length(seq) >= 58 group by family) r
  join (select family, count(*) as spacers, cast(sum(length(spacer)) // count(*) as bigint) as spacer_length, cast(sum(n) // count(*) as bigint) as coverage from (select family, spacer, count(*) as n from interior group by 1, 2) group by family) s on s.family = r.family"""
    )
}


def find_arrays(reads: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """Reads ``(read_id, seq)`` to array groups: ``hits``, ``groups``, ``spacers``, ``edges``, ``contigs``.

    Detection, grouping of variants, recruiting of single-repeat reads, consensus with splits, re-projection, spacer
    graph with cleaning, contigs, flankers, and the test of confidence; stages that others read twice are written out.
    """
    p = p.checked()
    found = durable.written(detect.oriented(detect.repeat_bearing(reads.select("read_id", "seq"), p)), "hits")
    groups = durable.written(cluster.grouped(detect.variants(found), p), "groups")
    patterns = recruit.nonredundant(groups)
    # all reads are searched where they lie, and only those with a match are compared with the reads found before
    more = recruit.not_found_before(recruit.matches(reads, patterns), found)
    span = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.length("pattern") - 1).cast("int").alias("stop")))
    single = detect.oriented(more.select("read_id", "seq", F.length("pattern").alias("repeat_len"), span.alias("repeats")))
    every = found.unionByName(single).join(groups, "variant")
    every = durable.written(every.select("gid", "variant", "read_id", "seq", "repeats", "repeat_len"), "every")
    held, true = consensus.consensus(every, p)
    true = durable.written(true, "true")
    moved, true = consensus.canonicalised(consensus.reprojected(held, true, p), true)
    # groups with the same true repeat are one
    names = durable.written(consensus.merged_identical(true), "names")
    true = true.join(names, "gid").where("gid = keep").drop("keep")
    moved = durable.written(moved.join(names, "gid").withColumn("gid", F.col("keep")).drop("keep"), "moved")
    given = durable.written(spacers.contributions(moved.withColumnRenamed("gid", "family"), p.node_kmer), "given")
    table = durable.written(graph.spacers(given), "spacers")
    jumps = durable.written(graph.jumping_edges(given, table), "jumps")
    nodes_left = clean.cleaned_nodes(graph.inner_edges(table).unionByName(jumps), durable.written(graph.nodes(given), "nodes"), durable.written(graph.read_nodes(given), "read-nodes"))
    edges = clean.cleaned_spacers(graph.spacer_edges(table, nodes_left))
    named = clean.flankers(table)
    sure = clean.confident(named, p.min_coverage)
    return {"given": given, "hits": moved, "groups": true.join(sure.select(F.col("family").alias("gid")), "gid", "left_semi"), "spacers": named.join(sure.select("family"), "family", "left_semi"), "edges": edges, "contigs": clean.contigs(edges)}

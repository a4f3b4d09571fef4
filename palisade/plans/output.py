"""From the result of :func:`palisade.plans.flagship.find_arrays` to the tables of a result file, and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.durable import numbered, written
from ..sources import arrays_xml, dot, seqfile


def tables(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The flat tables of :mod:`palisade.operators.report`; ids are numbers within each group, read ids accessions."""
    groups = found["groups"]
    named = numbered(groups.select("gid"), "gid").select("gid", F.concat(F.lit("G"), F.col("number").cast("string")).alias("name"))
    key = F.concat_ws(":", "low", "high")
    number = F.row_number().over(W.partitionBy("family").orderBy("ord_read", "ord_idx")).cast("string")
    held = found["spacers"].join(named, F.col("family") == F.col("gid")).drop("gid")
    held = written(held.select(F.col("name").alias("gid"), "family", "low", "high", key.alias("spacer"), "seq", F.col("coverage").alias("cov"), "flanker", number.alias("number")), "result")
    tag = F.when(F.col("flanker"), "FL").otherwise("SP")
    held = held.withColumn("spid", F.concat(tag, "number"))
    given = found["given"].where("first is not null and last is not null").select("family", F.least("first", "last").alias("low"), F.greatest("first", "last").alias("high"), "read_id")
    behind = held.join(given, ["family", "low", "high"]).select("gid", "spid", F.concat(F.lit("SO"), F.col("read_id").cast("string")).alias("soid"), F.col("read_id").cast("string").alias("accession")).distinct()
    contig = found["contigs"].join(held.select("family", "spacer", "gid", "spid"), ["family", "spacer"])
    ends = clean._both_ways(found["edges"]).join(contig.select("family", F.col("spacer").alias("a"), "gid", "spid", "contig"), ["family", "a"])
    ends = ends.join(held.select("family", F.col("spacer").alias("b"), F.col("spid").alias("target")), ["family", "b"])
    cid = F.concat(F.lit("C"), F.col("contig").cast("string")).alias("cid")
    return {
        "groups": groups.join(named, "gid").select(F.col("name").alias("gid"), F.col("true_dr").alias("drseq")),
        "drs": groups.join(named, "gid").select(F.col("name").alias("gid"), F.lit("DR1").alias("drid"), F.col("true_dr").alias("seq")),
        "spacers": held.where("not flanker").select("gid", "spid", "seq", "cov"),
        "flankers": held.where("flanker").select("gid", F.col("spid").alias("flid"), "seq"),
        "sources": behind.select("gid", "soid", "accession").distinct(),
        "spacer_sources": behind.where("spid like 'SP%'").select("gid", "spid", "soid"),
        "cspacers": contig.select("gid", cid, "spid"),
        "links": ends.select("gid", cid, "spid", F.when(F.col("way") == "F", "fs").otherwise("bs").alias("kind"), "target"),
    }


def write(found: dict[str, DataFrame], reads: DataFrame, path: str) -> None:
    """``path``/result.xml, ``path``/reads (FASTA by group) and ``path``/graphs (one text a group)."""
    t = tables(found)
    arrays_xml.write(arrays_xml.nested(t), f"{path}/result.xml")
    support = t["sources"].select("gid", F.col("accession").cast("long").alias("read_id"))
    seqfile.write_groups(reads.select("read_id", "seq"), support, f"{path}/reads")
    graphs(t).select("gid", F.col("text").alias("value")).write.partitionBy("gid").text(f"{path}/graphs")


def graphs(t: dict[str, DataFrame]) -> DataFrame:
    """``(gid, text)``: the spacer graph of each group, forward links only."""
    flankers = t["flankers"].select("gid", F.col("flid").alias("spid"), "seq", F.lit(0).cast("long").alias("cov"), F.lit(True).alias("flanker"))
    held = t["spacers"].select("gid", "spid", "seq", F.col("cov").cast("long").alias("cov"), F.lit(False).alias("flanker")).unionByName(flankers)
    limits = t["spacers"].groupBy("gid").agg(F.min("cov").cast("double").alias("low"), F.max("cov").cast("double").alias("high"))
    contig = t["cspacers"].select("gid", "spid", F.regexp_replace("cid", "^C", "").alias("contig"))
    nodes = dot.node_lines(held.join(contig, ["gid", "spid"], "left").join(limits, "gid"))
    edges = dot.edge_lines(t["links"].where("kind in ('fs', 'ff')").select("gid", F.col("spid").alias("src"), F.col("target").alias("dst")))
    return dot.graph_text(nodes, edges)


def assembler_commands(kind: str, fasta: str, overlap: int, out: str) -> list[list[str]]:
    """Command lines that hand selected reads to an external assembler, which must be installed: ``velvet`` or ``cap3``."""
    if kind == "velvet":
        return [["velveth", out, str(overlap), "-fasta", fasta], ["velvetg", out]]
    if kind == "cap3":
        return [["cap3", fasta, "-o", str(overlap)]]
    raise ValueError("velvet or cap3")


def assemble(kind: str, fasta: str, overlap: int, out: str) -> None:
    import subprocess

    for command in assembler_commands(kind, fasta, overlap, out):
        subprocess.run(command, check=True)

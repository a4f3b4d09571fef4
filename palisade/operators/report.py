"""The tools: relational verbs over flattened result files.

Tables: ``groups(gid, drseq)``, ``drs(gid, drid, seq)``, ``spacers(gid, spid, seq, cov)``, ``flankers(gid, flid, seq)``,
``sources(gid, soid, accession)``, ``spacer_sources(gid, spid, soid)``, ``cspacers(gid, cid, spid)``,
``links(gid, cid, spid, kind, target)``.  Results are new tables; an input is never overwritten.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .durable import numbered, written

ROW = ["drs", "dr_length", "spacers", "spacer_length", "coverage", "flankers", "flanker_length", "reads"]


def group_ids(spark: SparkSession, given: str | Iterable[str]) -> DataFrame:
    """``(gid)`` from a comma-separated string, a list, or a file of ids between white space (a path with a slash)."""
    if isinstance(given, str) and "/" in given:
        words = spark.read.text(given).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("gid")).where("gid <> ''")
        return words.select(F.regexp_replace("gid", "^(?=[0-9])", "G").alias("gid")).distinct()
    names = given.split(",") if isinstance(given, str) else given
    names = sorted({n.strip() if not n.strip()[:1].isdigit() else "G" + n.strip() for n in names if n.strip()})
    return spark.createDataFrame([(n,) for n in names], "gid string")


def statistics(groups: DataFrame, drs: DataFrame, spacers: DataFrame, flankers: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each group: counts and integer means, zero where there is nothing."""

    def part(df, name, *aggs):
        return df.groupBy("gid").agg(*aggs)

    d = part(drs, "drs", F.count("*").alias("drs"), stats.int_mean(F.length("seq")).alias("dr_length"))
    s = part(spacers, "spacers", F.count("*").alias("spacers"), stats.int_mean(F.length("seq")).alias("spacer_length"), stats.int_mean("cov").alias("coverage"))
    f = part(flankers, "flankers", F.count("*").alias("flankers"), stats.int_mean(F.length("seq")).alias("flanker_length"))
    r = part(sources, "reads", F.count("*").alias("reads"))
    out = groups.select("gid", "drseq")
    for t in (d, s, f, r):
        out = out.join(t, "gid", "left")
    return out.select("gid", "drseq", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ROW])


def totals(rows: DataFrame) -> DataFrame:
    """The row over all groups: sums of counts, and integer means of the groups' means (of the reads too)."""
    sums, means = ("drs", "spacers", "flankers"), ("dr_length", "spacer_length", "coverage", "flanker_length", "reads")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums], *[stats.int_mean(c).alias(c) for c in means]).select(*ROW)


def tabular(rows: DataFrame, separator: str = "\t") -> DataFrame:
    """``(gid, line)``: a line of text for each row of :func:`statistics`."""
    return rows.select("gid", F.concat_ws(separator, "gid", "drseq", *[F.col(c).cast("string") for c in ROW]).alias("line"))


def header(separator: str = "\t") -> str:
    return separator.join(["gid", "drseq", *ROW])


def run_stamp(moment):
    """Day, month, year and time of day as file names carry them."""
    return F.date_format(moment, "dd_MM_yyyy_HHmmss")


def coverage_histogram(spacers: DataFrame) -> DataFrame:
    """``(gid, histogram)``: ``cov:count`` in ascending order, each followed by a comma."""
    counted = spacers.groupBy("gid", "cov").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("cov", "n")))
    return counted.groupBy("gid").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["cov"].cast("string"), F.lit(":"), p["n"].cast("string"), F.lit(","))), "").alias("histogram"))


def bars(rows: DataFrame) -> DataFrame:
    """``(gid, bar)``: a dash for each repeat, a plus for each spacer, a tilde for each flanker."""
    bar = lambda c, n: F.repeat(F.lit(c), F.col(n).cast("int"))
    return rows.select("gid", F.concat(bar("-", "drs"), bar("+", "spacers"), bar("~", "flankers")).alias("bar"))


def filtered(groups: DataFrame, drs: DataFrame, spacers: DataFrame, flankers: DataFrame, min_drs: int = 0, min_spacers: int = 0, min_flankers: int = 0) -> DataFrame:
    """Groups with at least so many of each; a group without flankers passes the flanker test; no criterion, no group."""
    if not (min_drs or min_spacers or min_flankers):
        return groups.where("false")
    out = groups
    for df, least in ((drs, min_drs), (spacers, min_spacers)):
        if least:
            out = out.join(df.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") >= least), "gid", "left_semi")
    if min_flankers:
        out = out.join(flankers.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") < min_flankers), "gid", "left_anti")
    return out.select(*groups.columns)


def covered(spacers: DataFrame, cspacers: DataFrame, links: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spacers covered at least so often; those dropped go from contigs and, at either end, from links."""
    gone = spacers.where(F.col("cov") < least).select("gid", "spid")
    kept = spacers.where(F.col("cov") >= least)
    inside = cspacers.join(gone, ["gid", "spid"], "left_anti").select(*cspacers.columns)
    ends = links.join(gone, ["gid", "spid"], "left_anti").join(gone.withColumnRenamed("spid", "target"), ["gid", "target"], "left_anti")
    return kept, inside, ends.select(*links.columns)


def extracted(table: DataFrame, kind: str, prefix: str = "", with_coverage: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """``(gid, id, record)``: FASTA records of repeats, spacers or flankers."""
    key = {"drs": "drid", "spacers": "spid", "flankers": "flid"}[kind]
    table = table if wanted is None else table.join(wanted, "gid", "left_semi")
    header = F.concat(F.lit(">" + prefix), "gid", F.lit("_"), key)
    if kind == "spacers" and with_coverage:
        header = F.concat(header, F.lit("_Cov_"), F.col("cov").cast("string"))
    return table.select("gid", F.col(key).alias("id"), F.concat(header, F.lit("\n"), "seq").alias("record"))


def merged(files: list[DataFrame], renumber: bool = False) -> DataFrame:
    """The groups of all files one after another; ``renumber`` names them G1, G2 and so on in that order.

    ``files`` hold ``(gid, drseq, pos)``, ``pos`` being the place in the file.
    """
    out = None
    for i, f in enumerate(files):
        one = f.select(F.lit(i).alias("file"), "pos", "gid", "drseq")
        out = one if out is None else out.unionByName(one)
    if renumber:
        out = numbered(out, "file", "pos").withColumn("gid", F.concat(F.lit("G"), F.col("number").cast("string"))).drop("number")
    return out


def conflicts(merged_groups: DataFrame) -> DataFrame:
    """Ids that more than one group has: merging warns of them and keeps both."""
    return merged_groups.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")


def sanitised(groups: DataFrame, spacers: DataFrame, drs: DataFrame, flankers: DataFrame, cspacers: DataFrame) -> dict[str, DataFrame]:
    """New ids in order of place: groups throughout, repeats, spacers and contigs from 1 in each group, flankers on and
    on; references follow.  Tables carry ``pos``."""
    gids = numbered(groups, "pos").select("gid", F.concat(F.lit("G"), F.col("number").cast("string")).alias("new_gid"))
    within = lambda df, name, tag: df.withColumn(name, F.concat(F.lit(tag), F.row_number().over(W.partitionBy("gid").orderBy("pos")).cast("string")))
    sp, dr = within(spacers, "new_spid", "SP"), within(drs, "new_drid", "DR")
    fl = numbered(flankers, "pos").withColumn("new_flid", F.concat(F.lit("F"), F.col("number").cast("string"))).drop("number")
    cids = cspacers.groupBy("gid", "cid").agg(F.min("pos").alias("pos"))
    cids = within(cids, "new_cid", "C").select("gid", "cid", "new_cid")
    inside = cspacers.join(cids, ["gid", "cid"]).join(sp.select("gid", "spid", "new_spid"), ["gid", "spid"], "left")
    named = lambda df: df.join(gids, "gid")
    return {"groups": named(groups), "spacers": named(sp), "drs": named(dr), "flankers": named(fl), "cspacers": named(inside)}


def renamed(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A whole result with new ids, as :func:`sanitised` gives them, in every table that refers to them."""
    place = F.struct("gid", "pos").alias("pos")
    flankers = t["flankers"].select("gid", "flid", "seq", place)
    new = sanitised(t["groups"].select("gid", "drseq", F.col("gid").alias("pos")), t["spacers"], t["drs"], flankers, t["cspacers"].withColumn("pos", F.struct("cid", "pos")))
    new = {k: written(v, k) for k, v in new.items()}
    spids = new["spacers"].select("gid", "spid", "new_gid", "new_spid")
    flids = new["flankers"].select("gid", "flid", "new_flid")
    cids = new["cspacers"].select("gid", "cid", "new_cid").distinct()
    gids = new["groups"].select("gid", "new_gid")
    ends = spids.select("gid", F.col("spid").alias("target"), F.col("new_spid").alias("to")).unionByName(flids.select("gid", F.col("flid").alias("target"), F.col("new_flid").alias("to")))
    links = t["links"].join(cids, ["gid", "cid"]).join(spids, ["gid", "spid"]).join(ends, ["gid", "target"])
    return {
        "groups": new["groups"].select(F.col("new_gid").alias("gid"), "drseq"),
        "drs": new["drs"].select(F.col("new_gid").alias("gid"), F.col("new_drid").alias("drid"), "seq"),
        "spacers": new["spacers"].select(F.col("new_gid").alias("gid"), F.col("new_spid").alias("spid"), "seq", "cov"),
        "flankers": new["flankers"].select(F.col("new_gid").alias("gid"), F.col("new_flid").alias("flid"), "seq"),
        "sources": t["sources"].join(gids, "gid").select(F.col("new_gid").alias("gid"), "soid", "accession"),
        "spacer_sources": t["spacer_sources"].join(spids, ["gid", "spid"]).select(F.col("new_gid").alias("gid"), F.col("new_spid").alias("spid"), "soid"),
        "cspacers": new["cspacers"].select(F.col("new_gid").alias("gid"), F.col("new_cid").alias("cid"), F.col("new_spid").alias("spid")),
        "links": links.select(F.col("new_gid").alias("gid"), F.col("new_cid").alias("cid"), F.col("new_spid").alias("spid"), "kind", F.col("to").alias("target")),
    }


def removed(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("gid"), "gid", "left_anti")


def wanted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("gid"), "gid", "left_semi")


def supporting_reads(cspacers: DataFrame, spacer_sources: DataFrame, sources: DataFrame, gid: str, contigs: list[str]) -> DataFrame:
    """``(accession)``: reads behind the spacers of the chosen contigs of a group."""
    chosen = cspacers.where(F.col("gid") == gid).where(F.col("cid").isin(contigs)).select("gid", "spid")
    return chosen.join(spacer_sources, ["gid", "spid"]).join(sources, ["gid", "soid"]).select("accession").distinct()


def assembler_overlap(groups: DataFrame) -> DataFrame:
    """``(gid, overlap)``: the overlap an external assembler is asked for."""
    return groups.select("gid", (F.length("drseq") + 8).alias("overlap"))


def traced(ids: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """``(read_id, stage, rows)``: how listed reads go through named stages."""
    out = None
    for name, df in stages.items():
        one = df.join(ids.select("read_id"), "read_id", "left_semi").groupBy("read_id").agg(F.count("*").alias("rows")).withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("read_id", "stage", "rows")

"""Command line: ``python -m palisade VERB ...``; an unknown verb prints the usage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palisade", description=__doc__)
    verbs = p.add_subparsers(dest="verb")

    def verb(name, *files, **options):
        v = verbs.add_parser(name)
        for f in files:
            v.add_argument(f, nargs="+" if f == "files" else None)
        v.add_argument("-o", "--out")
        for k, kind in options.items():
            v.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    verb("find", "files", min_repeat=int, max_repeat=int, min_spacer=int, max_spacer=int, window=int, min_repeats=int, shared_kmers=int, node_kmer=int, min_coverage=int)
    verb("stat", "files", aggregate=bool, coverage=bool, pretty=bool, no_header=bool, separator=str, groups=str)
    verb("filter", "files", spacers=int, drs=int, flankers=int, coverage=int)
    verb("extract", "files", spacers=bool, drs=bool, flankers=bool, groups=str, prefix=str, no_coverage=bool)
    verb("merge", "files", sanitise=bool)
    verb("sanitise", "files")
    verb("rm", "files", groups=str)
    verb("draw", "files", groups=str)
    verb("reads", "files", group=str, contigs=str)
    return p


def main(argv: list[str]) -> int:
    p = arguments()
    known = set(p._subparsers._group_actions[0].choices)
    if not argv or argv[0] not in known:
        p.print_usage()
        return 0
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from .operators import report
    from .params import Params
    from .plans import flagship, output
    from .sources import arrays_xml, seqfile

    def show(df, column):
        for r in df.toLocalIterator():
            print(r[column])

    if a.verb == "find":
        reads = seqfile.read(spark, *a.files).select(F.xxhash64("file", "name").alias("read_id"), "name", "seq")
        given = {k: v for k in Params.__dataclass_fields__ if (v := getattr(a, k, None)) is not None}
        output.write(flagship.find_arrays(reads, Params(**given)), reads, a.out or "found")
        return 0
    df = arrays_xml.read(spark, *a.files)
    t = arrays_xml.flattened(df)
    if a.verb == "stat":
        t = {k: report.wanted(v, report.group_ids(spark, a.groups)) for k, v in t.items()} if a.groups else t
        rows = report.statistics(t["groups"], t["drs"], t["spacers"], t["flankers"], t["sources"]).orderBy("gid")
        if a.coverage:
            show(report.coverage_histogram(t["spacers"]).select(F.concat_ws("\t", "gid", "histogram").alias("line")), "line")
        elif a.pretty:
            show(report.bars(rows).select(F.concat_ws("\t", "gid", "bar").alias("line")), "line")
        else:
            separator = a.separator or "\t"
            if not a.no_header:
                print(report.header(separator))
            show(report.tabular(rows, separator), "line")
            if a.aggregate:
                print(separator.join(map(str, report.totals(rows).first())))
        return 0
    if not a.out and a.verb not in ("extract", "reads"):
        raise SystemExit("an output is needed: inputs are never overwritten")
    if a.verb == "filter":
        if a.coverage:
            t["spacers"], t["cspacers"], t["links"] = report.covered(t["spacers"], t["cspacers"], t["links"], a.coverage)
        keep = report.filtered(t["groups"], t["drs"], t["spacers"], t["flankers"], a.drs or 0, a.spacers or 0, a.flankers or 0) if a.drs or a.spacers or a.flankers else t["groups"] if a.coverage else t["groups"].where("false")
        arrays_xml.write(arrays_xml.nested({k: report.wanted(v, keep.select("gid")) for k, v in t.items()}), a.out)
    elif a.verb == "extract":
        if not (a.spacers or a.drs or a.flankers):
            raise SystemExit("one of --spacers, --drs and --flankers is needed")
        ids = report.group_ids(spark, a.groups) if a.groups else None
        parts = [report.extracted(t[k], k, a.prefix or "", not a.no_coverage, ids) for k in ("spacers", "drs", "flankers") if getattr(a, k)]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        out.select("record").write.text(a.out) if a.out else show(out, "record")
    elif a.verb == "merge":
        arrays_xml.write(df if not a.sanitise else _renumbered(df), a.out)
    elif a.verb == "sanitise":
        arrays_xml.write(arrays_xml.nested(report.renamed(t)), a.out)
    elif a.verb == "draw":
        t = {k: report.wanted(v, report.group_ids(spark, a.groups)) for k, v in t.items()} if a.groups else t
        output.graphs(t).select("gid", F.col("text").alias("value")).write.partitionBy("gid").text(a.out)
    elif a.verb == "rm":
        arrays_xml.write(df.join(report.group_ids(spark, a.groups or "").select(F.col("gid").alias("_gid")), "_gid", "left_anti").select(*df.columns), a.out)
    elif a.verb == "reads":
        show(report.supporting_reads(t["cspacers"], t["spacer_sources"], t["sources"], a.group, ["C" + c.lstrip("C") for c in (a.contigs or "").split(",")]), "accession")
    return 0


def _renumbered(df):
    """Groups named G1, G2, ... by their former ids."""
    from .operators.durable import numbered

    out = numbered(df.withColumn("__id", F.col("_gid")), "__id")
    return out.withColumn("_gid", F.concat(F.lit("G"), F.col("number").cast("string"))).select(*df.columns)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Result files: nested XML with a ``group`` for each array type, read into flat tables and written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary of the format.
_LINK = "array<struct<_drid:string,_drconf:string,_spid:string>>"
_FLANK = "array<struct<_flid:string,_drconf:string,_directjoin:string>>"
_SOURCE = "array<struct<_soid:string>>"
SCHEMA = f"""_gid string, _drseq string,
data struct<sources:struct<source:array<struct<_accession:string,_soid:string>>>,
  drs:struct<dr:array<struct<_drid:string,_seq:string>>>,
  spacers:struct<spacer:array<struct<_cov:int,_seq:string,_spid:string,source:{_SOURCE}>>>,
  flankers:struct<flanker:array<struct<_flid:string,_seq:string,source:{_SOURCE}>>>>,
metadata struct<program:struct<name:string,version:string,command:string>,notes:string,file:array<struct<_type:string,_url:string>>>,
assembly struct<contig:array<struct<_cid:string,cspacer:array<struct<_spid:string,
  bspacers:struct<bs:{_LINK}>,fspacers:struct<fs:{_LINK}>,bflankers:struct<bf:{_FLANK}>,fflankers:struct<ff:{_FLANK}>>>>>>"""


def read(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "group").schema(SCHEMA).load(list(paths))


def write(groups: DataFrame, path: str) -> None:
    out = groups.write.format("xml").option("rootTag", 'crispr version="1.1"').option("rowTag", "group")
    out.option("declaration", 'version="1.0" encoding="ISO-8859-1" standalone="no"').save(path)


def _rows(df: DataFrame, array: str, *names: str) -> DataFrame:
    columns = [F.col(f"x._{n}").alias(n) for n in names]
    return df.select(F.col("_gid").alias("gid"), F.posexplode(array).alias("pos", "x")).select("gid", "pos", *columns, "x")


def flattened(df: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of :mod:`palisade.operators.report`."""
    contigs = _rows(df, "assembly.contig", "cid")
    inside = contigs.select("gid", "cid", F.posexplode("x.cspacer").alias("pos", "c")).select("gid", "cid", "pos", F.col("c._spid").alias("spid"), "c")

    def links(kind: str, array: str, target: str) -> DataFrame:
        return inside.select("gid", "cid", "spid", F.explode(array).alias("l")).select("gid", "cid", "spid", F.lit(kind).alias("kind"), F.col(f"l._{target}").alias("target"))

    joined = links("bs", "c.bspacers.bs", "spid")
    for kind, array, target in (("fs", "c.fspacers.fs", "spid"), ("bf", "c.bflankers.bf", "flid"), ("ff", "c.fflankers.ff", "flid")):
        joined = joined.unionByName(links(kind, array, target))
    spacers = _rows(df, "data.spacers.spacer", "spid", "seq", "cov")
    return {
        "groups": df.select(F.col("_gid").alias("gid"), F.col("_drseq").alias("drseq")),
        "sources": _rows(df, "data.sources.source", "soid", "accession").drop("x"),
        "drs": _rows(df, "data.drs.dr", "drid", "seq").drop("x"),
        "spacers": spacers.drop("x"),
        "spacer_sources": spacers.select("gid", "spid", F.explode("x.source").alias("s")).select("gid", "spid", F.col("s._soid").alias("soid")),
        "flankers": _rows(df, "data.flankers.flanker", "flid", "seq").drop("x"),
        "cspacers": inside.drop("c"),
        "links": joined,
        "files": df.select(F.col("_gid").alias("gid"), F.explode("metadata.file").alias("f")).select("gid", F.col("f._type").alias("type"), F.col("f._url").alias("url")),
    }


def nested(t: dict[str, DataFrame], program: tuple[str, str, str] = ("palisade", "1.0", "")) -> DataFrame:
    """The nested form of flat tables; a table that is missing leaves its elements out."""
    out = t["groups"].select("gid", "drseq")

    def add(name: str, rows: DataFrame | None, struct, order: str) -> None:
        nonlocal out
        if rows is None:
            out = out.withColumn(name, F.lit(None))
        else:
            held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), struct.alias("v"))))
            out = out.join(rows.groupBy("gid").agg(F.transform(held, lambda x: x["v"]).alias(name)), "gid", "left")

    add("source", t.get("sources"), F.struct(F.col("accession").alias("_accession"), F.col("soid").alias("_soid")), "soid")
    add("dr", t.get("drs"), F.struct(F.col("drid").alias("_drid"), F.col("seq").alias("_seq")), "drid")
    spacers = t["spacers"]
    if "spacer_sources" in t:
        of = t["spacer_sources"].groupBy("gid", "spid").agg(F.transform(F.array_sort(F.collect_list("soid")), lambda s: F.struct(s.alias("_soid"))).alias("of"))
        spacers = spacers.join(of, ["gid", "spid"], "left")
    else:
        spacers = spacers.withColumn("of", F.lit(None).cast(_SOURCE))
    add("spacer", spacers, F.struct(F.col("cov").cast("int").alias("_cov"), F.col("seq").alias("_seq"), F.col("spid").alias("_spid"), F.col("of").alias("source")), "spid")
    add("flanker", t.get("flankers"), F.struct(F.col("flid").alias("_flid"), F.col("seq").alias("_seq")), "flid")
    inside = t.get("cspacers")
    if inside is not None:
        one = F.struct(F.col("spid").alias("_spid"), *[F.col(c) for c in ("bspacers", "fspacers")])
        for tag, name in (("bs", "bspacers"), ("fs", "fspacers")):
            ends = t["links"].where(F.col("kind") == tag).groupBy("gid", "cid", "spid").agg(F.array_sort(F.collect_list("target")).alias("to"))
            element = F.struct(F.transform("to", lambda x: F.struct(F.lit("DR1").alias("_drid"), F.lit("0").alias("_drconf"), x.alias("_spid"))).alias(tag))
            inside = inside.join(ends, ["gid", "cid", "spid"], "left").withColumn(name, F.when(F.col("to").isNotNull(), element)).drop("to")
        contigs = inside.groupBy("gid", "cid").agg(F.struct(F.col("cid").alias("_cid"), F.array_sort(F.collect_list(one)).alias("cspacer")).alias("c"))
        add("contig", contigs, F.col("c"), "cid")
    else:
        out = out.withColumn("contig", F.lit(None))
    data = [F.struct("source").alias("sources"), F.struct("dr").alias("drs"), F.struct("spacer").alias("spacers"), F.when(F.size("flanker") > 0, F.struct("flanker")).alias("flankers")]
    if t.get("flankers") is None:
        data = data[:3]
    meta = F.struct(F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "version", "command"), program)]).alias("program"))
    out = out.select(F.col("gid").alias("_gid"), F.col("drseq").alias("_drseq"), F.struct(*data).alias("data"), meta.alias("metadata"), *([F.struct("contig").alias("assembly")] if inside is not None else []))
    return out

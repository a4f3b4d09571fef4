"""Relations derived from the star schema, as DataFrames and as SQL by the same rules."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, spacers
from ..operators.durable import written
from ..sources import synthetic as Y


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return Y.table(self.spark, self.sf_dir, name)

    @cached_property
    def reads(self) -> DataFrame:
        return Y.reads(self.spark, self.sf_dir)

    @cached_property
    def hits(self) -> DataFrame:
        return Y.with_repeats(self.reads)

    @cached_property
    def families(self) -> DataFrame:
        n = F.col("id").cast("int")
        return self.spark.range(Y.FAMILIES).select(n.alias("family"), Y.dna(F.concat(F.lit("dr"), n.cast("string"))).alias("dr"))

    @cached_property
    def interior(self) -> DataFrame:
        return spacers.spacers_of(self.hits.select("read_id", "family", "seq", "repeats")).select("read_id", "family", "idx", "spacer")

    @cached_property
    def given(self) -> DataFrame:
        return spacers.contributions(self.hits.select("read_id", "family", "seq", "repeats"))

    @cached_property
    def held(self) -> DataFrame:
        return graph.spacers(self.given)

    # what queries on graphs read several times is written out, as :func:`flagship.find_arrays` does

    @cached_property
    def kept(self) -> DataFrame:
        return written(self.given, "given")

    @cached_property
    def table_of_spacers(self) -> DataFrame:
        return written(graph.spacers(self.kept), "spacers")

    @cached_property
    def jumps(self) -> DataFrame:
        return graph.jumping_edges(self.kept, self.table_of_spacers)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.inner_edges(self.table_of_spacers).unionByName(written(self.jumps, "jumps"))

    @cached_property
    def spacer_edges(self) -> DataFrame:
        return graph.spacer_edges(self.table_of_spacers, self.jumps)

    @cached_property
    def spacer_graph(self) -> DataFrame:
        return written(self.spacer_edges, "spacer-edges")

    @cached_property
    def near(self) -> DataFrame:
        """Variants of the repeats that differ in an end: some bases cut from either side."""
        cuts = self.families.select("family", "dr", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("cut"))
        return cuts.select(F.col("family").alias("gid"), F.expr("substring(dr, 1 + cut, 32 - 2 * cut % 7)").alias("variant"), (F.col("family") * 10 + F.col("cut")).alias("ord")).distinct()

    # the tables of a result file

    @cached_property
    def groups(self) -> DataFrame:
        return self.families.select(self._gid(), F.col("dr").alias("drseq"), F.col("family").cast("long").alias("pos"))

    def _gid(self):
        return F.concat(F.lit("G"), (F.col("family") + 1).cast("string")).alias("gid")

    @cached_property
    def drs(self) -> DataFrame:
        return self.groups.select("gid", F.lit("DR1").alias("drid"), F.col("drseq").alias("seq"), F.lit(1).cast("long").alias("pos"))

    @cached_property
    def spacers(self) -> DataFrame:
        seen = self.interior.groupBy("family", F.col("spacer").alias("seq")).agg(F.count("*").alias("cov"))
        number = F.row_number().over(W.partitionBy("family").orderBy("seq"))
        return seen.select(self._gid(), number.cast("long").alias("pos"), "seq", "cov").withColumn("spid", F.concat(F.lit("SP"), F.col("pos").cast("string")))

    @cached_property
    def flankers(self) -> DataFrame:
        some = self.reads.where("read_id % 500 = 0")
        return some.select(self._gid(), F.concat(F.lit("FL"), F.col("read_id").cast("string")).alias("flid"), F.substring("seq", 1, 32).alias("seq"), F.col("read_id").alias("pos"))

    @cached_property
    def sources(self) -> DataFrame:
        key = F.col("read_id").cast("string")
        return self.reads.select(self._gid(), F.concat(F.lit("SO"), key).alias("soid"), F.concat(F.lit("read"), key).alias("accession"))

    @cached_property
    def spacer_sources(self) -> DataFrame:
        of = self.interior.select(self._gid(), F.col("spacer").alias("seq"), F.concat(F.lit("SO"), F.col("read_id").cast("string")).alias("soid")).distinct()
        return of.join(self.spacers.select("gid", "seq", "spid"), ["gid", "seq"]).select("gid", "spid", "soid")

    @cached_property
    def cspacers(self) -> DataFrame:
        return self.spacers.select("gid", F.concat(F.lit("C"), (F.col("pos") % 3 + 1).cast("string")).alias("cid"), "spid", "pos")

    @cached_property
    def links(self) -> DataFrame:
        after = F.lead("spid").over(W.partitionBy("gid", "cid").orderBy("pos"))
        return self.cspacers.withColumn("target", after).where("target is not null").select("gid", "cid", "spid", F.lit("fs").alias("kind"), "target")


G = "'G' || (family + 1)"
SQL = {
    "reads": Y.READS_SQL,
    "families": f"select cast(i as integer) as family, {Y.dna_sql(chr(39) + 'dr' + chr(39) + ' || i')} as dr from range({Y.FAMILIES}) t(i)",
    "interior": "select read_id, family, cast(i as integer) as idx, substr(seq, 65 + 64 * i, 32) as spacer from (select *, unnest(range(n_spacers)) as i from reads)",
    "given": """select family, read_id, 0 as idx, substr(seq, 1, 32) as spacer, cast(null as varchar) as first, substr(seq, 26, 7) as last from reads
      union all select family, read_id, idx + 1, spacer, substr(spacer, 1, 7), substr(spacer, 26, 7) from interior""",
    "held": """select family, least(first, last) as low, greatest(first, last) as high, arg_min(first, (read_id, idx)) as leader, arg_min(last, (read_id, idx)) as last,
      arg_min(spacer, (read_id, idx)) as seq, count(*) as coverage, min((read_id, idx))[1] as ord_read, min((read_id, idx))[2] as ord_idx
      from given where first is not null group by family, least(first, last), greatest(first, last)""",
    "steps": "select distinct family, src, first as dst from (select *, lag(last) over (partition by read_id order by idx) as src from given) where src is not null and first is not null",
    "ahead": "select * from steps s where not exists (select 1 from held h where h.family = s.family and h.low = least(s.src, s.dst) and h.high = greatest(s.src, s.dst))",
    "jumps": "select family, src, dst, 'JF' as etype from ahead union all select family, dst, src, 'JB' from ahead",
    "inner_edges": "select family, leader as src, last as dst, 'F' as etype from held union all select family, last, leader, 'B' from held",
    "spacer_edges": """select distinct j.family, a.low as src_low, a.high as src_high, b.low as dst_low, b.high as dst_high
      from ahead j join held a on a.family = j.family and a.last = j.src join held b on b.family = j.family and b.leader = j.dst where a.low <> b.low or a.high <> b.high""",
    "ways": "select family, src_low || ':' || src_high as a, dst_low || ':' || dst_high as b, 'F' as way from spacer_edges union all select family, dst_low || ':' || dst_high, src_low || ':' || src_high, 'R' from spacer_edges",
    "spacer_rank": "select family, a as spacer, count(*) as rank, cast(count(*) filter (where way = 'F') as bigint) as ahead, cast(count(*) filter (where way = 'R') as bigint) as back from ways group by family, a",
    "near": "select distinct family as gid, substr(dr, cast(1 + cut as bigint), cast(32 - 2 * cut % 7 as bigint)) as variant, cast(family * 10 + cut as integer) as ord from families, range(6) t(cut)",
    "groups": f"select {G} as gid, dr as drseq, cast(family as bigint) as pos from families",
    "drs": "select gid, 'DR1' as drid, drseq as seq, cast(1 as bigint) as pos from groups",
    "spacers": f"select gid, pos, seq, cov, 'SP' || pos as spid from (select {G} as gid, row_number() over (partition by family order by spacer) as pos, spacer as seq, count(*) as cov from interior group by family, spacer)",
    "flankers": f"select {G} as gid, 'FL' || read_id as flid, substr(seq, 1, 32) as seq, read_id as pos from reads where read_id % 500 = 0",
    "sources": f"select {G} as gid, 'SO' || read_id as soid, 'read' || read_id as accession from reads",
    "spacer_sources": f"select distinct s.gid, s.spid, 'SO' || i.read_id as soid from (select *, {G} as gid from interior) i join spacers s on s.gid = i.gid and s.seq = i.spacer",
    "cspacers": "select gid, 'C' || (pos % 3 + 1) as cid, spid, pos from spacers",
    "links": "select gid, cid, spid, 'fs' as kind, target from (select *, lead(spid) over (partition by gid, cid order by pos) as target from cspacers) where target is not null",
    "stat": """select g.gid, g.drseq, cast(coalesce(d.n, 0) as bigint) as drs, cast(coalesce(d.l, 0) as bigint) as dr_length, cast(coalesce(s.n, 0) as bigint) as spacers, cast(coalesce(s.l, 0) as bigint) as spacer_length,
      cast(coalesce(s.c, 0) as bigint) as coverage, cast(coalesce(f.n, 0) as bigint) as flankers, cast(coalesce(f.l, 0) as bigint) as flanker_length, cast(coalesce(r.n, 0) as bigint) as reads
      from groups g left join (select gid, count(*) n, sum(length(seq)) // count(*) l from drs group by gid) d on d.gid = g.gid
      left join (select gid, count(*) n, sum(length(seq)) // count(*) l, sum(cov) // count(*) c from spacers group by gid) s on s.gid = g.gid
      left join (select gid, count(*) n, sum(length(seq)) // count(*) l from flankers group by gid) f on f.gid = g.gid
      left join (select gid, count(*) n from sources group by gid) r on r.gid = g.gid""",
}


def sql(query: str) -> str:
    """``query`` with the relations it names before it, in order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in order and re.search(rf"(?:from|join)\s+{name}\b|,\s*{name}\b(?!\s*\.)", text) and name != text:
                if SQL[name] is text:
                    continue
                need(SQL[name])
                if name not in order:
                    order.append(name)

    need(query)
    return "with " + ",\n".join(f"{n} as materialized ({SQL[n]})" for n in order) + "\n" + query if order else query

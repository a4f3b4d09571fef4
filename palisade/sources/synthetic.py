"""Sequencing reads derived from the star schema, by the same rule in Spark and in SQL.

A read is an order: a flank, then a repeat (of the customer's family) before each spacer (one a line item) and a closing
repeat.  ``dna`` turns the MD5 of a string into 32 bases.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES, LENGTH = "0123456789abcdef", "ACGTACGTACGTACGT", 32
FAMILIES, SPACERS = 20, 400


def dna(x: Column) -> Column:
    return F.translate(F.md5(x), HEX, BASES)


def _known(prefix: str, n: int) -> list[str]:
    """:func:`dna` of ``prefix0``, ``prefix1``, ... worked out here: a row then picks its string instead of hashing."""
    table = str.maketrans(HEX, BASES)
    return [hashlib.md5(f"{prefix}{i}".encode()).hexdigest().translate(table) for i in range(n)]


def _picked(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def dna_sql(x: str) -> str:
    return f"translate(md5({x}), '{HEX}', '{BASES}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(read_id, family, dr, seq, n_spacers)``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # spacers go by their rank in byte order until the read is put together
    known = _known("sp", SPACERS)
    ranked = sorted(known)
    rank = {x: i for i, x in enumerate(ranked)}
    items = items.select("l_orderkey", "l_linenumber", _picked([rank[x] for x in known], F.col("l_partkey") % SPACERS).alias("rank"))
    lines = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "rank"))).alias("lines"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    family = (F.col("o_custkey") % FAMILIES).cast("int")
    dr = _picked(_known("dr", FAMILIES), family)
    flank = dna(F.concat(F.lit("fl"), F.col("o_orderkey").cast("string")))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.col("dr"), _picked(ranked, x["rank"]))), "")
    named = joined.select(F.col("o_orderkey").alias("read_id"), family.alias("family"), dr.alias("dr"), flank.alias("flank"), "lines")
    return named.select("read_id", "family", "dr", F.concat("flank", body, "dr").alias("seq"), F.size("lines").cast("long").alias("n_spacers"))


READS_SQL = f"""
  select o_orderkey as read_id, cast(o_custkey % {FAMILIES} as integer) as family, {dna_sql("'dr' || (o_custkey % 20)")} as dr,
    {dna_sql("'fl' || o_orderkey")} || string_agg({dna_sql("'dr' || (o_custkey % 20)")} || sp, '' order by l_linenumber, sp) || {dna_sql("'dr' || (o_custkey % 20)")} as seq,
    count(*) as n_spacers
  from orders join (select l_orderkey, l_linenumber, {dna_sql(f"'sp' || (l_partkey % {SPACERS})")} as sp from lineitem) on o_orderkey = l_orderkey
  group by o_orderkey, o_custkey
"""


def with_repeats(reads: DataFrame) -> DataFrame:
    """Adds ``repeats``, the places of the repeats by construction."""
    at = lambda i: F.struct((LENGTH + 2 * LENGTH * i).cast("int").alias("start"), (2 * LENGTH - 1 + 2 * LENGTH * i).cast("int").alias("stop"))
    return reads.withColumn("repeats", F.transform(F.sequence(F.lit(0), F.col("n_spacers").cast("int")), at))

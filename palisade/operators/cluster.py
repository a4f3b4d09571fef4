"""Grouping repeat variants by the k-mers they share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..params import CLUSTER_KMER, Params
from .durable import components

#: Greedy grouping visits variants one after another; up to this number all in one task, beyond it island by island.
MAX_GREEDY = 200_000


def variant_kmers(variants: DataFrame, k: int = CLUSTER_KMER) -> DataFrame:
    """``(variant, place, kmer)``, k-mers in canonical form."""
    return variants.select("variant", F.posexplode(S.kmers("variant", k)).alias("place", "kmer")).withColumn("kmer", S.canonical("kmer"))


def shared_kmers(variants: DataFrame, k: int = CLUSTER_KMER) -> DataFrame:
    """``(a, b, shared)``: pairs of variants, ``a < b``, with the number of canonical k-mers they have in common."""
    kmers = variant_kmers(variants, k).select("variant", "kmer").distinct()
    pairs = kmers.select(F.col("variant").alias("a"), "kmer").join(kmers.select(F.col("variant").alias("b"), "kmer"), "kmer").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def grouped(variants: DataFrame, p: Params = Params()) -> DataFrame:
    """``(gid, variant)`` from ``variants(variant, ord)``.

    Greedy at every size: in order of ``ord``, a variant joins the first group to reach ``shared_kmers`` of its k-mers,
    else opens one; k-mers nobody owns become the group's.  Beyond ``MAX_GREEDY`` variants this is done in each island
    by itself: variants of different islands have no k-mer in common even over others, so they never meet and the groups
    are the same.  ``gid`` is a label: 1, 2, ... in one task, else a hash of the variant that opens the group.
    """
    whole = variants.limit(MAX_GREEDY + 1).count() <= MAX_GREEDY
    need = p.shared_kmers
    numbered = variants.select("variant", "ord", S.kmers("variant", CLUSTER_KMER).alias("kmers"))
    numbered = numbered.withColumn("kmers", F.transform("kmers", S.canonical))
    if whole:
        numbered = numbered.withColumn("island", F.lit(""))
    else:
        numbered = numbered.join(islands(variants), "variant", "left").withColumn("island", F.coalesce("island", "variant"))

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, int] = {}
        gids, openers, free = [], [], 1
        frame = frame.sort_values(["ord", "variant"])
        for variant, kmers in zip(frame["variant"], frame["kmers"]):
            votes: dict[int, int] = {}
            gid = 0
            for x in kmers:
                g = owner.get(x)
                if g is not None:
                    votes[g] = votes.get(g, 0) + 1
                    if votes[g] >= need:
                        gid = g
                        break
            if not gid:
                gid, free = free, free + 1
                openers.append(variant)
            for x in kmers:
                owner.setdefault(x, gid)
            gids.append(gid)
        return pd.DataFrame({"gid": gids, "variant": frame["variant"], "opener": [openers[g - 1] for g in gids]})

    out = numbered.groupBy("island").applyInPandas(greedy, "gid int, variant string, opener string")
    return out.select("gid", "variant") if whole else out.select(F.xxhash64("opener").alias("gid"), "variant")


def islands(variants: DataFrame) -> DataFrame:
    """``(variant, island)``: components of variants that have any k-mer in common, for those that share one."""
    kmers = variant_kmers(variants).select("variant", "kmer").distinct()
    first = kmers.groupBy("kmer").agg(F.min("variant").alias("a"))
    links = kmers.join(first, "kmer").where("a <> variant").select(F.lit(0).alias("gid"), "a", F.col("variant").alias("b")).distinct()
    return components(links).select(F.col("node").alias("variant"), F.col("root").alias("island"))


def by_components(variants: DataFrame, p: Params = Params()) -> DataFrame:
    pairs = shared_kmers(variants).where(F.col("shared") >= p.shared_kmers).select(F.lit(0).alias("gid"), "a", "b")
    roots = components(pairs).select(F.col("node").alias("variant"), "root")
    out = variants.select("variant").join(roots, "variant", "left").withColumn("root", F.coalesce("root", "variant"))
    names = out.select("root").distinct().withColumn("gid", F.xxhash64("root"))
    return out.join(names, "root").select("gid", "variant")


def masters(groups: DataFrame) -> DataFrame:
    """``(gid, master)``: the longest variant of each group, of equally long ones that seen first."""
    return groups.groupBy("gid").agg(F.max_by("variant", F.struct(F.length("variant"), -F.col("ord"))).alias("master"))

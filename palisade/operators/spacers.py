"""Repeats and spacers of reads: generators over the repeat positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def repeats_of(hits: DataFrame) -> DataFrame:
    """A row for each repeat: ``(..., idx, start, stop, repeat)``."""
    keep = [c for c in hits.columns if c != "repeats"]
    out = hits.select(*keep, F.posexplode("repeats").alias("idx", "r")).select(*keep, "idx", "r.start", "r.stop")
    return out.withColumn("repeat", S.stretch("seq", "start", "stop"))


def spacers_of(hits: DataFrame) -> DataFrame:
    """A row for each interior spacer: ``(..., idx, spacer)``."""
    keep = [c for c in hits.columns if c != "repeats"]
    return hits.select(*keep, F.posexplode(S.interior_spacers("seq", "repeats")).alias("idx", "spacer"))


def stretches_of(hits: DataFrame) -> DataFrame:
    """Spacers with the overhangs at both ends: ``(..., idx, spacer, is_first, is_last)``, empty overhangs left out.

    ``is_first`` marks what precedes the first repeat, ``is_last`` what follows the last one.
    """
    keep = [c for c in hits.columns if c != "repeats"]
    head = F.struct(F.substring("seq", F.lit(1), F.element_at("repeats", 1)["start"]).alias("spacer"), F.lit(True).alias("is_first"), F.lit(False).alias("is_last"))
    tail = F.struct(F.substring("seq", F.element_at("repeats", -1)["stop"] + 2, F.length("seq")).alias("spacer"), F.lit(False).alias("is_first"), F.lit(True).alias("is_last"))
    inner = F.transform(S.interior_spacers("seq", "repeats"), lambda s: F.struct(s.alias("spacer"), F.lit(False).alias("is_first"), F.lit(False).alias("is_last")))
    out = hits.select(*keep, F.posexplode(F.concat(F.array(head), inner, F.array(tail))).alias("idx", "s"))
    return out.select(*keep, "idx", "s.spacer", "s.is_first", "s.is_last").where(F.length("spacer") > 0)


def read_averages(hits: DataFrame) -> DataFrame:
    """Average repeat and spacer lengths of each read, by integer division.

    The sum of repeat lengths leaves the last repeat out, yet is divided by all.
    """
    sizes = F.transform("repeats", lambda r: r["stop"] - r["start"] + 1)
    total = F.aggregate(F.slice(sizes, F.lit(1), F.size(sizes) - 1), F.lit(0), lambda a, x: a + x)
    spacers = F.transform(S.interior_spacers("seq", "repeats"), lambda s: F.length(s))
    between = F.aggregate(spacers, F.lit(0), lambda a, x: a + x)
    return hits.select(
        "read_id",
        F.floor(total / F.size("repeats")).cast("long").alias("average_repeat"),
        F.when(F.size(spacers) > 0, F.floor(between / F.greatest(F.size(spacers), F.lit(1)))).otherwise(0).cast("long").alias("average_spacer"),
    )


def contributions(hits: DataFrame, k: int = 7) -> DataFrame:
    """What reads give to the k-mer graph: ``(family, read_id, idx, spacer, first, last)``.

    An interior spacer gives its first and last k-mer, a leading overhang only its last, a trailing one only its first;
    stretches shorter than ``k`` give nothing.
    """
    s = stretches_of(hits).where(F.length("spacer") >= k)
    first = F.when(~F.col("is_first"), F.substring("spacer", 1, k))
    last = F.when(~F.col("is_last"), F.substring("spacer", -k, k))
    return s.select("family", "read_id", "idx", "spacer", first.alias("first"), last.alias("last"))

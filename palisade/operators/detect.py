"""Finding repeat-bearing reads.

The exact search runs in Arrow batches, all reads of a batch at once.  A filter that Catalyst sees goes before it: the
length gate, which drops what the search would refuse at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batched
from ..functions import sequence as S
from ..params import MAX_REPEAT_SPACER_LENGTH_DIFFERENCE, MAX_SPACER_LENGTH_DIFFERENCE, Params

REPEATS = "array<struct<start:int,stop:int>>"


def long_enough(reads: DataFrame, p: Params = Params()) -> DataFrame:
    return reads.where(F.length("seq") >= p.shortest_read)


def seeds(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """``(read_id, seed_at, seed, area_at, area)``: every seed of a read with the stretch its second copy may lie in."""
    last = F.length("seq") - p.shortest_read
    at = long_enough(reads, p).select("read_id", "seq", F.explode(F.sequence(F.lit(0), last, F.lit(p.stride))).alias("seed_at"))
    low = F.col("seed_at") + p.min_repeat + p.min_spacer
    high = F.greatest(low, F.least(F.col("seed_at") + p.max_repeat + p.max_spacer + p.window, F.length("seq") - 1))
    return at.select("read_id", "seed_at", F.substring("seq", F.col("seed_at") + 1, F.lit(p.window)).alias("seed"), low.alias("area_at"), F.substring("seq", low + 1, high - low).alias("area"))


def seed_hits(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """``(read_id, seed_at, hit_at)``: seeds that turn up again within reach, with the first place."""
    found = seeds(reads, p).withColumn("place", F.instr("area", F.col("seed")))
    return found.where("place > 0").select("read_id", "seed_at", (F.col("area_at") + F.col("place") - 1).alias("hit_at"))


def seeded(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Reads with at least one seed hit; the search of a read ends with its first, and nothing is shuffled.

    The read stands once in the condition: pushed below the projection that makes it, it isn't made again for each seed.
    """

    def searched(seq):
        def hit(j):
            low = j + p.min_repeat + p.min_spacer
            high = F.greatest(low, F.least(j + p.max_repeat + p.max_spacer + p.window, F.length(seq) - 1))
            return F.contains(F.substring(seq, low + 1, high - low), F.substring(seq, j + 1, F.lit(p.window)))

        places = F.sequence(F.lit(0), F.length(seq) - p.shortest_read, F.lit(p.stride))
        return F.when(F.length(seq) >= p.shortest_read, F.exists(places, hit)).otherwise(F.lit(False))

    return reads.where(F.exists(F.array("seq"), searched))


def first_seed_hits(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """The leftmost seed hit of each read: an aggregate that combines before its shuffle."""
    return seed_hits(reads, p).groupBy("read_id").agg(F.min(F.struct("seed_at", "hit_at")).alias("m")).select("read_id", "m.seed_at", "m.hit_at")


def repeat_bearing(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Reads with repeats that pass all checks, with ``repeats`` and ``repeat_len``; other columns pass through."""
    names = reads.columns
    at = names.index("seq")
    schema = T.StructType([*reads.schema.fields, T.StructField("repeat_len", T.IntegerType()), T._parse_datatype_string(f"repeats {REPEATS}").fields[0]])

    def run(batches):
        for batch in batches:
            rows, lengths, counts, starts, stops = batched.find_repeats(batch.column(at).to_pylist(), p)
            places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["start", "stop"])
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(ends, places)], names=[*names, "repeat_len", "repeats"])

    return long_enough(reads, p).mapInArrow(run, schema)


def checks(hits: DataFrame, p: Params = Params()) -> DataFrame:
    """Spacer statistics of each read and the rules on lengths: ``(read_id, n, shortest, longest, spacer_step,
    repeat_step, lengths_fit)``."""
    spacers = F.transform(S.interior_spacers("seq", "repeats"), lambda s: F.length(s))
    repeat = F.element_at("repeats", 1)["stop"] - F.element_at("repeats", 1)["start"] + 1
    sized = hits.select("read_id", spacers.alias("sizes"), repeat.alias("repeat"))
    n = F.size("sizes")
    steps = F.abs(F.element_at("sizes", 1) - F.element_at("sizes", -1)) / F.greatest(n - 1, F.lit(1))
    inner = F.aggregate(F.slice("sizes", F.lit(1), n - 1), F.lit(0), lambda a, x: a + x)
    apart = F.abs(F.col("repeat") * (n - 1) - inner) / F.greatest(n - 1, F.lit(1))
    out = sized.where(n >= 2).select(
        "read_id", n.cast("long").alias("n"), F.array_min("sizes").alias("shortest"), F.array_max("sizes").alias("longest"), F.floor(steps).cast("int").alias("spacer_step"), F.floor(apart).cast("int").alias("repeat_step")
    )
    fits = (F.col("shortest") >= p.min_spacer) & (F.col("longest") <= p.max_spacer) & (F.col("spacer_step") <= MAX_SPACER_LENGTH_DIFFERENCE) & (F.col("repeat_step") <= MAX_REPEAT_SPACER_LENGTH_DIFFERENCE)
    return out.withColumn("lengths_fit", fits)


def short_checks(hits: DataFrame, p: Params = Params()) -> DataFrame:
    """``(read_id, n, apart, lengths_fit)`` of reads with one spacer, which is compared without its last base."""
    one = hits.where(F.size("repeats") == 2)
    n = F.length(S.spacer_without_last("seq", "repeats", 0))
    repeat = F.element_at("repeats", 1)["stop"] - F.element_at("repeats", 1)["start"] + 1
    out = one.select("read_id", n.alias("n"), F.abs(n - repeat).alias("apart"))
    return out.withColumn("lengths_fit", F.col("n").between(p.min_spacer, p.max_spacer) & (F.col("apart") <= MAX_REPEAT_SPACER_LENGTH_DIFFERENCE))


def without_partials(hits: DataFrame) -> DataFrame:
    """Drops repeats that touch an end of their read."""
    inside = F.filter("repeats", lambda r: (r["start"] > 0) & (r["stop"] < F.length("seq") - 1))
    return hits.withColumn("repeats", inside)


def oriented(hits: DataFrame) -> DataFrame:
    """Adds ``variant``, the canonical form of the representative repeat, and turns a read round where that is the other
    strand's (palindromes are turned); ``turned`` says so."""
    shown = hits.withColumn("shown", S.representative_repeat("seq", "repeats"))
    turned: Column = F.col("shown") >= S.reverse_complement("shown")
    out = shown.withColumn("turned", turned).withColumn("variant", F.when(turned, S.reverse_complement("shown")).otherwise(F.col("shown")))
    repeats = F.when(F.col("turned"), S.mirrored("repeats", F.length("seq"))).otherwise(F.col("repeats"))
    return out.withColumn("repeats", repeats).withColumn("seq", F.when(F.col("turned"), S.reverse_complement("seq")).otherwise(F.col("seq"))).drop("shown")


def variants(hits: DataFrame) -> DataFrame:
    """``(variant, n_reads, ord)``: distinct repeat variants, ``ord`` being the first read that shows each."""
    return hits.groupBy("variant").agg(F.count("*").alias("n_reads"), F.min("read_id").alias("ord"))

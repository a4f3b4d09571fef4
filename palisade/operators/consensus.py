"""The true repeat of each group: alignment of variants, votes by column, the zone, collapse and split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import batched, kernels
from ..functions import sequence as S
from ..params import COLLAPSE_CONSERVATION, COLLAPSE_SHARE, MAX_TRIMER_SHARE, MIN_COLUMN_DEPTH, ZONE_CONSERVATION, Params
from .cluster import masters
from .durable import written


def aligned(groups: DataFrame) -> DataFrame:
    """``(gid, variant, ord, master, offset, reversed)``: variants along their group's master; those without a clear
    place are dropped.  A column ``longer`` of ``groups``, the variant with two more bases on either side, decides
    between the strands where the variant alone doesn't."""
    longer = F.col("longer") if "longer" in groups.columns else F.lit(None).cast("string").alias("longer")
    pairs = groups.join(masters(groups), "gid").select("gid", "variant", "ord", "master", longer)
    pairs = pairs.repartition(2 * groups.sparkSession.sparkContext.defaultParallelism)  # a small table, much work a row

    def run(batches):
        for batch in batches:
            found = batched.offsets_to_masters(*(batch.column(i).to_pylist() for i in (1, 3, 4)))
            offsets, turned = pa.array([o for o, _ in found], pa.int32()), pa.array([t for _, t in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], offsets, turned], names=["gid", "variant", "ord", "master", "offset", "reversed"])

    kind = dict(pairs.dtypes)
    schema = f"gid {kind['gid']}, variant string, ord {kind['ord']}, master string, offset int, reversed boolean"
    return pairs.mapInArrow(run, schema).where("offset is not null")


def shown_variants(hits: DataFrame) -> DataFrame:
    """``(gid, variant, ord, longer)``: the variants of each group, the first read that shows each, and the variant with
    its neighbours from the first read that has two bases on either side."""
    at = F.expr("filter(repeats, r -> substring(seq, r.start + 1, r.stop - r.start + 1) = variant and r.start >= 2 and r.stop + 2 < length(seq))")
    near = hits.withColumn("r", F.get(at, F.lit(0)))
    # one pass, combined before the shuffle: a row for each variant and task goes on, never the reads
    wide = F.substring("seq", F.col("r.start") - 1, F.col("r.stop") - F.col("r.start") + 5)
    first = F.min(F.when(F.col("r").isNotNull(), F.struct("read_id", wide.alias("wide"))))
    shown = near.groupBy("gid", "variant").agg(F.min("read_id").alias("ord"), first.alias("first"))
    return shown.select("gid", "variant", "ord", F.col("first.wide").alias("longer"))


def coverage(hits: DataFrame, reach: int | None = None) -> DataFrame:
    """``(gid, pos, base, n)``: how often each base lies at each place along the master.

    ``hits(gid, seq, repeats, offset, repeat_len)``.  Every repeat of full length places its whole read (or ``reach``
    bases either side of it); leading partial repeats are passed over, and a later one ends the read's turn.  Bases are
    counted batch by batch, and counts added up before they are shuffled.
    """
    full = lambda r: r["stop"] - r["start"] + 1 == F.col("repeat_len")
    first = F.array_position(F.transform("repeats", full), True)
    rest = F.slice("repeats", F.greatest(first, F.lit(1)).cast("int"), F.size("repeats"))
    whole = F.transform(rest, full)
    upto = F.array_position(whole, False)
    run = F.slice(rest, F.lit(1), F.when(upto > 0, upto - 1).otherwise(F.size("repeats")).cast("int"))
    placed = hits.where(first > 0).select(F.col("gid").alias("gid"), "seq", F.col("offset").cast("int").alias("offset"), F.transform(run, lambda r: r["start"]).alias("starts"), F.transform(run, lambda r: r["stop"]).alias("stops"))

    def counted(batches):
        for batch in batches:
            gids = batch.column(0).dictionary_encode()
            counts = np.diff(batch.column(3).offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            starts, stops = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
            parts = batched.base_counts(batch.column(1).to_pylist(), gids.indices.to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64), owner, starts, stops, reach)
            for group, pos, base, n in parts:
                names = pa.array(["A", "C", "G", "T"]).take(pa.array(base))
                yield pa.RecordBatch.from_arrays([gids.dictionary.take(pa.array(group)), pa.array(pos, pa.int32()), names, pa.array(n, pa.int64())], names=["gid", "pos", "base", "n"])

    rows = placed.mapInArrow(counted, f"gid {dict(placed.dtypes)['gid']}, pos int, base string, n long")
    return rows.groupBy("gid", "pos", "base").agg(F.sum("n").alias("n"))


def columns(cover: DataFrame) -> DataFrame:
    """``(gid, pos, consensus, depth, conservation)``: the most frequent base (of equal ones the first of A, C, G, T) and
    its share where the column is deep enough, else 0."""
    rank = F.struct("n", -F.ascii("base"))
    out = cover.groupBy("gid", "pos").agg(F.max_by("base", rank).alias("consensus"), F.max("n").alias("most"), F.sum("n").alias("depth"))
    share = F.when(F.col("depth") > MIN_COLUMN_DEPTH, F.col("most") / F.col("depth")).otherwise(F.lit(0.0))
    return out.select("gid", "pos", "consensus", "depth", share.alias("conservation"))


def zones(cols: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(gid, zone_start, zone_end)`` from ``lengths(gid, master_length)``, the master lying from 0 on.

    Each end goes inwards to the first column whose outer neighbour is conserved, then outwards while it is: the start is
    that of the conserved island of the first conserved column from -1 on, the end likewise.
    """
    inside = cols.where(F.col("conservation") >= ZONE_CONSERVATION)
    island = inside.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("gid").orderBy("pos")))
    spans = island.groupBy("gid", "island").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    held = spans.join(lengths, "gid")
    start = F.min(F.when(F.col("high") >= -1, F.col("low")))
    end = F.max(F.when(F.col("low") <= F.col("master_length"), F.col("high")))
    return held.groupBy("gid").agg(start.alias("zone_start"), end.alias("zone_end")).where("zone_start <= zone_end")


def true_repeats(cols: DataFrame, zone: DataFrame) -> DataFrame:
    """``(gid, true_dr)``: the consensus over the zone."""
    inside = cols.join(zone, "gid").where("pos between zone_start and zone_end")
    letters = F.array_sort(F.collect_list(F.struct("pos", "consensus")))
    return inside.groupBy("gid").agg(F.array_join(F.transform(letters, lambda x: x["consensus"]), "").alias("true_dr"))


def suspects(cover: DataFrame, cols: DataFrame, zone: DataFrame) -> DataFrame:
    """``(gid, pos, base, share)``: bases with a share of at least ``COLLAPSE_SHARE`` in columns of the zone that are
    conserved too little, where at least two have it."""
    weak = cols.join(zone, "gid").where("pos between zone_start and zone_end").where(F.col("conservation") < COLLAPSE_CONSERVATION).where(F.col("depth") > MIN_COLUMN_DEPTH)
    shares = cover.join(weak.select("gid", "pos", "depth"), ["gid", "pos"]).withColumn("share", F.col("n") / F.col("depth")).where(F.col("share") >= COLLAPSE_SHARE)
    many = shares.groupBy("gid", "pos").agg(F.count("*").alias("forms")).where("forms >= 2")
    return shares.join(many.select("gid", "pos"), ["gid", "pos"]).select("gid", "pos", "base", "share")


def collapsed(variants: DataFrame, suspected: DataFrame) -> DataFrame:
    """``(gid, pos)``: the first suspected column of each group in which the variants themselves show two of the bases."""
    place = F.col("pos") - F.col("offset")
    shown = suspected.join(variants.select("gid", "variant", "offset"), "gid").where((place >= 0) & (place < F.length("variant"))).where(F.substring("variant", place + 1, F.lit(1)) == F.col("base"))
    forms = shown.groupBy("gid", "pos").agg(F.count_distinct("base").alias("forms")).where("forms >= 2")
    return forms.groupBy("gid").agg(F.min("pos").alias("pos"))


def split(hits: DataFrame, where: DataFrame) -> DataFrame:
    """Reads with a new ``gid`` where their group collapses: one for each base found at the column, read from the
    variant or, where it doesn't reach there, from the read.  ``gid`` is a string that grows by ``.base``."""
    at = F.col("pos") - F.col("offset")
    start = F.element_at("repeats", 1)["start"]
    base = F.when((at >= 0) & (at < F.length("variant")), F.substring("variant", at + 1, F.lit(1))).otherwise(F.substring("seq", start + at + 1, F.lit(1)))
    joined = hits.join(where, "gid", "left").withColumn("base", F.when(F.col("pos").isNotNull(), base))
    return joined.where("pos is null or base <> ''").withColumn("gid", F.when(F.col("base").isNull(), F.col("gid")).otherwise(F.concat_ws(".", "gid", "base"))).drop("pos", "base")


def consensus(hits: DataFrame, p: Params = Params(), max_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """``(hits, groups)``: reads with their final ``gid`` and ``offset``, and ``(gid, zone_start, zone_end, true_dr)``.

    ``hits(gid, variant, read_id, seq, repeats, repeat_len)``.  Groups whose columns show two forms are split and looked
    at again, until none splits; each split strictly divides the variants.
    """
    hits = hits.withColumn("gid", F.col("gid").cast("string"))
    for _ in range(max_rounds):
        placed = written(aligned(written(shown_variants(hits), "variants")), "aligned")
        held = hits.join(placed.select("gid", "variant", "offset", "reversed"), ["gid", "variant"])
        held = _turned(held)
        held = written(held, "placed")
        cover = written(coverage(held, p.max_repeat), "coverage")
        cols = columns(cover)
        lengths = placed.groupBy("gid").agg(F.first(F.length("master")).alias("master_length"))
        zone = written(zones(cols, lengths), "zones")
        where = written(collapsed(placed.where("not reversed"), suspects(cover, cols, zone)), "collapsed")
        if not where.limit(1).count():
            return held, gated(true_repeats(cols, zone).join(zone, "gid"), p)
        hits = written(split(held, where).drop("offset"), "split")
    raise RuntimeError("groups did not settle")


def _turned(hits: DataFrame) -> DataFrame:
    """Reads of variants that align reversed, on the other strand."""
    back = F.col("reversed")
    out = hits.withColumn("repeats", F.when(back, S.mirrored("repeats", F.length("seq"))).otherwise(F.col("repeats")))
    out = out.withColumn("seq", F.when(back, S.reverse_complement("seq")).otherwise(F.col("seq")))
    return out.withColumn("variant", F.when(back, S.reverse_complement("variant")).otherwise(F.col("variant"))).drop("reversed")


def gated(groups: DataFrame, p: Params = Params()) -> DataFrame:
    """Groups whose true repeat has a fitting length, is complex enough and holds no 3-mer too often."""
    n = F.length("true_dr")
    return groups.where(n.between(p.min_repeat, p.max_repeat)).where(~S.low_complexity("true_dr")).where(S.trimer_share("true_dr") <= MAX_TRIMER_SHARE)


def canonicalised(hits: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """True repeats in canonical form; reads of groups that turn are turned with them."""
    turning = groups.withColumn("turn", S.canonical("true_dr") != F.col("true_dr"))
    held = hits.join(turning.select("gid", "turn"), "gid")
    repeats = F.when(F.col("turn"), S.mirrored("repeats", F.length("seq"))).otherwise(F.col("repeats"))
    held = held.withColumn("repeats", repeats).withColumn("seq", F.when(F.col("turn"), S.reverse_complement("seq")).otherwise(F.col("seq"))).drop("turn")
    return held, groups.withColumn("true_dr", S.canonical("true_dr"))


def reprojected(hits: DataFrame, groups: DataFrame, p: Params = Params()) -> DataFrame:
    """Repeats of each read moved onto the true repeat of its group, cut-off repeats at both ends added."""
    flat = lambda name: F.transform("repeats", lambda r: r[name]).alias(name)
    joined = hits.join(groups.select("gid", "true_dr", "zone_start"), "gid").select("gid", "read_id", "seq", flat("start"), flat("stop"), (F.col("offset") - F.col("zone_start")).cast("int").alias("front"), "true_dr")

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            moved = [kernels.onto_true_repeat(seq, list(zip(starts, stops)), front, repeat, p) for seq, starts, stops, front, repeat in zip(*columns)]
            ends = pa.array(np.cumsum([0, *map(len, moved)]), pa.int32())
            both = np.array([x for m in moved for x in m], np.int32).reshape(-1, 2)
            places = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, places)], names=["gid", "read_id", "seq", "repeats"])

    return joined.mapInArrow(run, f"gid {dict(joined.dtypes)['gid']}, read_id long, seq string, repeats array<struct<start:int,stop:int>>")


def merged_identical(groups: DataFrame) -> DataFrame:
    """``(gid, keep)``: groups with the same true repeat go by the smallest of their ids."""
    return groups.select("gid", F.min("gid").over(W.partitionBy("true_dr")).alias("keep"))

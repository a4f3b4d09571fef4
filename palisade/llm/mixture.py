"""Mixing sources to target weights, in fixed-length blocks of words.

Method.  The words of each source form one stream, cut into blocks of ``BLOCK`` words.  The output has ``SHARDS`` shards
of equal size; each draws how many of its slots every source gets, multinomially but without putting back the slots that
the targets provide, so that the counts of all shards add up to the targets.  The slots of a source are numbered through;
slot ``j`` takes block ``perm(j mod blocks)``, ``perm`` being a keyed pseudorandom permutation of that source's block
indexes, another for each full turn ``j div blocks``.  Blocks join their texts by (source, index).

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words; no target exceeds
``MAX_REPEAT`` times its source, the excess going to the others by weight until none exceeds it.  A block is taken at
most ``MAX_REPEAT`` times, since a source gets at most ``MAX_REPEAT`` times its blocks.

Scale.  Texts are counted in one pass.  Positions in a stream are prefix sums at two levels (within hash cells, then over
cells), each with about the square root of the rows, so that no source, however large, meets in one task.  The driver
sees one row a source and one number a shard and source.  A join by (source, index) has no hot key, as indexes are unique.

Defined results: null and empty texts have size 0 and are never taken; the null source is a source of its own; repeated
rows are separate documents; an empty table, or one without words, has an empty mix (targets 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, materialise

BLOCK, SHARDS, MAX_REPEAT, SEED = 128, 64, 3, 11
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` without their texts, with ``size``, the number of words."""
    others = [c for c in docs.columns if c not in ("text", "size")]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("size", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(others)).cast(pa.large_binary())
            sizes = pa.array([len(t.as_py().split()) if t.is_valid else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=schema.names)

    return docs.select(*others, F.col("text").cast("string")).mapInArrow(run, schema)


def targets(sizes: dict, weights: dict) -> dict:
    """Words to take of each source: shares by weight of the total, none above ``MAX_REPEAT`` times its size."""
    out, left, total = {s: 0.0 for s in sizes}, {s for s in sizes if sizes[s] > 0}, float(sum(sizes.values()))
    while left:
        share = total / sum(weights[s] for s in left)
        full = {s for s in left if share * weights[s] > MAX_REPEAT * sizes[s]}
        if not full:
            out |= {s: share * weights[s] for s in left}
            break
        for s in full:
            out[s] = float(MAX_REPEAT * sizes[s])
            total -= out[s]
        left -= full
    return out


def repeating_weights(sources) -> dict:
    """1, 2, 3, 1, ... in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sources if s is None]
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}


def positioned(sizes: DataFrame) -> DataFrame:
    """``sizes(doc_id, source, row, copy, size)``, a row for each document, with ``start``, the place of its first word
    in the source's stream."""
    n = sizes.count()
    cells = max(1, int(n**0.5))
    placed = sizes.withColumn("cell", F.pmod(F.xxhash64("doc_id", "row", "copy"), F.lit(cells)).cast("int"))
    per_cell = placed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = per_cell.select("source", "cell", (F.expr("sum(cell_size) over (partition by source order by cell)") - F.col("cell_size")).alias("cell_start"))
    rows = "rows between unbounded preceding and current row"
    placed = placed.withColumn("inner", F.expr(f"sum(size) over (partition by source, cell order by doc_id, row, copy {rows})") - F.col("size"))
    joined = placed.alias("a").join(before.alias("b"), F.expr("a.source <=> b.source and a.cell = b.cell"))
    return joined.select("a.*", "b.cell_start").withColumn("start", F.col("cell_start") + F.col("inner")).drop("cell", "inner", "cell_start")


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of ``range(size)``, vectorised: a Feistel network with cycle walking."""
    half = max(1, (max(1, int(size - 1).bit_length()) + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(6):
            with np.errstate(over="ignore"):
                x = (right + np.uint64(key & (1 << 63) - 1) + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (x >> np.uint64(31)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = out >= size
    return out.astype(np.int64)


class Plan:
    """What the driver decides: targets, blocks of each source, and slots of each shard and source."""

    def __init__(self, sizes: dict, weights: dict | None = None, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED):
        self.sources = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
        self.seed = seed
        self.targets = targets(sizes, weights or repeating_weights(sizes))
        # a small source has shorter blocks, so that its target is met closely too
        self.lengths = [max(1, min(block, sizes[s] // SHARDS)) for s in self.sources]
        self.blocks = [-(-sizes[s] // n) for s, n in zip(self.sources, self.lengths)]
        # a source's blocks hold size / blocks words on average: its last one may be short
        wanted = [min(MAX_REPEAT * b, round(self.targets[s] * b / sizes[s])) if sizes[s] else 0 for s, b in zip(self.sources, self.blocks)]
        rng, left, rows = np.random.default_rng(seed), np.array(wanted, np.int64), []
        for k in range(shards):
            take = int(left.sum()) // (shards - k)
            drawn = _draw(rng, left, take)
            rows.append(drawn)
            left = left - drawn
        self.slots = np.array(rows, np.int64).reshape(shards, len(self.sources))


def _draw(rng, left: np.ndarray, take: int) -> np.ndarray:
    """Multinomial counts of ``take`` slots, none more than is left."""
    out, rest = np.zeros_like(left), left.copy()
    while take and rest.sum():
        drawn = np.minimum(rng.multinomial(take, rest / rest.sum()), rest)
        out, rest, take = out + drawn, rest - drawn, take - int(drawn.sum())
    return out


def slots(spark, plan: Plan) -> DataFrame:
    """``(shard, slot, source_no, block)``: the block of each slot of the mix."""
    first = np.cumsum(plan.slots, axis=0) - plan.slots
    rows = [(k, s, int(first[k, s]), int(n)) for k in range(len(plan.slots)) for s, n in enumerate(plan.slots[k]) if n]
    drawn = spark.createDataFrame(rows, "shard int, source_no int, first long, n long")
    # ranges of bounded length, so that a large share of one source is dealt to many tasks
    step = 10_000
    drawn = drawn.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))).repartition(max(1, min(2000, 1 + sum(r[3] for r in rows) // 50_000)))
    blocks, seed = plan.blocks, plan.seed

    def run(frames):
        import pandas as pd

        for f in frames:
            for k, s, first, n, start in f.itertuples(index=False):
                i = np.arange(start, min(n, start + step), dtype=np.int64)
                turn, at = np.divmod(first + i, blocks[s])
                block = np.zeros(len(i), np.int64)
                for t in np.unique(turn):
                    block[turn == t] = permuted(at[turn == t], blocks[s], seed * 1_000_003 + s * 1009 + int(t))
                yield pd.DataFrame({"shard": k, "slot": i, "source_no": s, "block": block})

    return drawn.select("shard", "source_no", "first", "n", "from").mapInPandas(run, "shard int, slot long, source_no int, block long")


def prepared(docs: DataFrame, weights: dict | None = None) -> tuple[DataFrame, Plan]:
    """A row for every document, with its place in its source's stream, and the plan.  ``row`` is a hash of the text;
    rows that repeat id, source and text are numbered by ``copy``."""
    sizes = sized(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("row"), "text"))
    sizes = sizes.groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("copies"))
    # in two steps, so that no array is long even if one row makes up a large part of the table
    sizes = sizes.withColumn("from", F.explode(F.expr("sequence(1L, copies, 10000L)"))).withColumn("copy", F.explode(F.expr("sequence(from, least(copies, from + 9999))")))
    sizes = materialise(sizes.select("doc_id", "source", "row", "size", "copy"), "sizes")
    totals = {r[0]: int(r[1] or 0) for r in sizes.groupBy("source").agg(F.sum("size")).collect()}
    plan = Plan(totals, weights)
    numbers = [(s, i, totals[s], float(plan.targets[s]), plan.lengths[i]) for i, s in enumerate(plan.sources)]
    numbers = docs.sparkSession.createDataFrame(numbers, "name string, source_no int, source_size long, target double, length long")
    placed = positioned(sizes).join(F.broadcast(numbers), F.expr("source <=> name")).drop("name")  # one row a source
    return materialise(placed, "placed"), plan


def _parts():
    """Array of ``(block, offset, n)``: the part of a document in each block, ``offset`` from its own first word."""
    end = F.col("start") + F.col("size")
    length = F.col("length")

    def part(k):
        low = F.greatest(F.col("start"), k * length)
        return F.struct(k.alias("block"), (low - F.col("start")).alias("offset"), (F.least(end, (k + 1) * length) - low).alias("n"))

    return F.transform(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length)), part)


def taken(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``."""
    placed, plan = prepared(docs, weights)
    times = slots(docs.sparkSession, plan).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    parts = placed.where("size > 0").select("source_no", "start", F.explode(_parts()).alias("p")).select("source_no", "start", "p.block", "p.n")
    # source and first word name a document that has words
    # the planner takes the drawn slots for a small table; a merge join keeps them from being broadcast
    words = parts.join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    held = placed.where("size > 0").join(words, ["source_no", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    out = held.unionByName(none)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The mix itself: ``(shard, slot, source, block, doc_ids, text)``, a row for every slot.  The words of a block are
    joined by single spaces; ``doc_ids`` are the documents it is packed from, in order."""
    placed, plan = prepared(docs, weights)
    keys = placed.where("size > 0").select("doc_id", F.col("source").alias("source_of"), "row", "copy", "source_no", "start", "size", "length")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("name"), F.xxhash64("text").alias("hash"), "text")
    if keys.where("copy > 1").limit(1).count():  # then each repeated row is looked up once
        texts = texts.dropDuplicates(["id", "name", "hash"])
    held = keys.join(texts, F.expr("hash = row and id <=> doc_id and name <=> source_of"))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    held = held.withColumn("words", words).withColumn("parts", _parts())
    cut = F.transform("parts", lambda p: F.struct(p["block"].alias("block"), F.array_join(F.slice(F.col("words"), (p["offset"] + 1).cast("int"), p["n"].cast("int")), " ").alias("text")))
    cut = held.select("source_no", "source_of", "start", "doc_id", F.explode(cut).alias("p"))
    packed = cut.groupBy("source_no", "p.block").agg(F.first("source_of").alias("source"), F.array_sort(F.collect_list(F.struct("start", "doc_id", "p.text"))).alias("parts"))
    drawn = slots(docs.sparkSession, plan)
    return drawn.hint("merge").join(packed, ["source_no", "block"]).select(
        "shard", "slot", "source", "block", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text")
    )

"""SimHash near-duplicates by tiled exact comparison.

Method.  Every text gets a 64-bit fingerprint (majority of the bits of the XXH64 of its shingles).  The distinct
fingerprints are laid out in tiles: one cell for each vector of population counts of the four 16-bit quarters, cut by
hash into tiles of about ``TILE`` fingerprints (from ``FINER`` fingerprints on, the eight bytes instead of quarters).  Two fingerprints that differ in at most ``radius`` bits have count
vectors at an L1 distance of at most ``radius``, so pairs of tiles further apart are skipped and all others are compared
exactly with numpy exclusive-or and bit counts.  Each tile pair gives a spanning forest of its links, never all pairs.

Scale.  Copies collapse in the first aggregation (map-side combined).  Near copies share cells, and a cell of any size
is cut into bounded tiles.  The quarters leave 1.4 % of all pairs of random fingerprints at radius 2, bytes
0.02 %; the comparison stays quadratic with that factor.

Defined results: null text and text without words have fingerprint zero; null ``doc_id`` rows take part, and a group of
nothing but null ids has the null component; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, components, map_batches, materialise, spread_key

SEED = 42
TILE = 4096
BLOCK = 50_000  # shingles held at once
FINER = 50_000_000  # distinct fingerprints from which cells are counts of eight pieces


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        hashes = np.array([digest(flat[s:e], seed) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], np.uint64)
        if len(hashes) > 3000:
            columns = hashes.view(np.uint8).reshape(-1, 8)
            total += np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
        else:
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, carry: bool = False) -> DataFrame:
    """``(doc_id, fp)``, or with ``carry`` all columns and ``__fp``; it holds the 64 bits as a signed long."""
    docs = docs if carry else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    schema = schema if carry else T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            kept = batch.columns if carry else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=schema.names)

    return map_batches(docs, run, schema)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between two tiles, thinned to at most about ``len(a) + len(b)`` that connect as much."""
    rows, cols = [], []
    step = max(1, 2_000_000 // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        keep = a[i + k] != b[j]
        rows.append(i[keep] + k)
        cols.append(j[keep])
        if sum(map(len, rows)) > 8 * (len(a) + len(b)):
            rows, cols = (([x] for x in _thin(np.concatenate(rows), np.concatenate(cols), len(a), len(b))))
    i, j = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cols or [np.zeros(0, np.int64)])
    if len(i) > len(a) + len(b):
        i, j = _thin(i, j, len(a), len(b))
    return a[i], b[j]


def _thin(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A subset of the bipartite links that has the same components, by min-label hooking: each round keeps, for every
    node, one link to its smallest labelled neighbour."""
    label, picked = np.arange(n + m), []
    u, v, at = i, j + n, np.arange(len(i))
    while len(u):
        # every root takes the link to the smallest neighbouring label
        lu, lv = label[u], label[v]
        apart = lu != lv
        u, v, at, lu, lv = u[apart], v[apart], at[apart], lu[apart], lv[apart]
        if not len(u):
            break
        high, low = np.maximum(lu, lv), np.minimum(lu, lv)
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        picked.append(at[first])
        label_of = np.arange(n + m)
        label_of[high[first]] = low[first]
        while True:
            nxt = label_of[label_of]
            if np.array_equal(nxt, label_of):
                break
            label_of = nxt
        label = label_of[label]
    chosen = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    return i[chosen], j[chosen]


def _cell(counts: list, width: int):
    out = counts[0]
    for p in counts[1:]:
        out = out * (width + 1) + p
    return out.cast("int")


def near_links(nodes: DataFrame, radius: int = 2, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``nodes(fp)`` that connect whatever lies within ``radius`` bits.

    ``parts``, 4 or 8, is the number of pieces whose population counts make up a cell: by default 4, and 8 beyond
    ``FINER`` fingerprints, where fewer pairs are worth a finer grid.  Links come out the same.
    """
    if parts is None:
        parts = 8 if nodes.count() > FINER else 4
    width, names = 64 // parts, [f"q{i}" for i in range(parts)]
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {width * i}) & {(1 << width) - 1}")).cast("int") for i in range(parts)]
    placed = nodes.select("fp", *[c.alias(q) for c, q in zip(counts, names)])
    placed = placed.withColumn("cell", _cell([F.col(q) for q in names], width))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))
    if parts == 4:  # at most 17^4 cells exist, whatever the corpus: this table may be broadcast
        cells = F.broadcast(cells)
    tiles = placed.join(cells, "cell").withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = materialise(tiles.groupBy("cell", "cut").agg(F.collect_list("fp").alias("fps"), *[F.first(q).alias(q) for q in names]), "tiles")
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _steps(parts, radius)])
    left = tiles.select(F.col("cell").alias("cell1"), F.col("cut").alias("cut1"), F.col("fps").alias("fps1"), *names, F.explode(offsets).alias("d"))
    moved = [F.col(q) + F.col(f"d.d{i}") for i, q in enumerate(names)]
    left = left.where(" and ".join(f"{q} + d.d{i} between 0 and {width}" for i, q in enumerate(names)))
    left = left.select("cell1", "cut1", "fps1", _cell(moved, width).alias("cell")).join(cells.select("cell"), "cell", "left_semi")
    pairs = left.join(tiles.select("cell", "cut", "fps"), "cell").where("cell1 <> cell or cut1 <= cut").select("fps1", "fps")

    def compare(batches):
        for batch in batches:
            found_a, found_b = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = forest(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius)
                found_a.append(a)
                found_b.append(b)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (found_a, found_b)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors with an L1 length of at most ``radius``, one of each pair of opposites."""
    out = [()]
    for _ in range(parts):
        out = [(*d, x) for d in out for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in out if d >= (0,) * parts]


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, component_id, group)`` for every row of ``docs``; ``component_id`` is the smallest ``doc_id`` that
    is reachable over links of at most ``radius`` differing bits, ``group`` a fingerprint that names the component."""
    prints = materialise(fingerprints(docs, width), "prints")
    return prints.join(_members(prints, radius, tile), "fp").select("doc_id", "fp", "component_id", "group")


def _members(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """``(fp, component_id, group)`` for each distinct fingerprint."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = materialise(components(near_links(nodes.select("fp"), radius, tile)), "roots")
    ids = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first_id")
    lowest = ids.groupBy("root").agg(F.min("first_id").alias("lowest"))
    ids, lowest = ids.select("fp", "root", spread_key("root").alias("k")), lowest.select(spread_key("root").alias("k"), "lowest")
    linked = materialise(ids.join(lowest, "k").select("fp", "root", "lowest"), "linked")
    of = nodes.join(linked, "fp", "left")
    of = of.select("fp", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("component_id"), F.coalesce("root", "fp").alias("group"))
    return materialise(of, "members")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest ``doc_id`` (if rows repeat it, one of them; if no row
    of the group has an id, one of its rows)."""
    prints = materialise(fingerprints(docs, width), "prints")
    of = _members(prints, radius, tile)
    groups = prints.join(of, "fp").select("doc_id", "component_id")
    dropped = materialise(groups.where("doc_id <> component_id").select("doc_id"), "dropped")
    kept = docs.where("doc_id is not null").join(dropped, "doc_id", "left_anti").select(*columns(docs))
    if prints.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # an id doesn't name a row: rows are told apart by id and fingerprint
        first = prints.join(of, "fp").where("doc_id = component_id")
        first = first.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"), F.col("group").alias("__group")).distinct()
        named = fingerprints(docs.where("doc_id is not null"), width, carry=True)
        kept = named.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__of"))).dropDuplicates(["__group"]).select(*columns(docs))
    if prints.where("doc_id is null").limit(1).count():
        nameless = fingerprints(docs.where("doc_id is null"), width, carry=True)
        named = of.where("component_id is null").select(F.col("fp").alias("__fp"), F.col("group").alias("__group"))
        kept = kept.unionByName(nameless.join(named, "__fp").dropDuplicates(["__group"]).select(*columns(docs)))
    return kept


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

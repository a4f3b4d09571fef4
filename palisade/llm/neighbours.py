"""Nearest neighbours by cosine: block matrix join with int8 products.

Method.  Unit vectors are stored as int8 codes times a scale, with the norm of what rounding left over.  A tile product
of the codes (exact in float32) gives approximate cosines and, by the Cauchy-Schwarz inequality, a bound on each one's
error.  A pair survives if its upper bound reaches the query's k-th largest lower bound; survivors are recomputed in
double precision on the original vectors and enter the query's heap.  The heaps of all tasks are merged by rank.  The
search is exact: no true neighbour can be lost, as its upper bound is never below the k-th lower bound.

Scale.  Queries come in blocks of ``QUERY_BLOCK`` (by hash of the id), and one block at a time meets all candidates where
these are read; candidates are never shuffled.  What is broadcast is one block, a fixed number of vectors.  Each task
keeps ``k`` neighbours a query.

Defined results: vectors that are null, empty, zero, or with null or non-finite parts take no part, neither do null ids;
vectors meet those of their own dimension only.  Rows with the query's id are the query's own.  An id that is
repeated counts once, with its nearest vector; a query id that is repeated is answered once, for its smallest vector in
dictionary order.  Ties go to the smaller id.  An empty table gives no rows.  Columns beside id and vector, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

TILE, QUERY_BLOCK, K, EVERY = 4096, 16_384, 5, 50
SCHEMA = "query_id long, vec_id long, score double"


def vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the usable rows, by dimension."""
    column = column.cast(pa.list_(pa.float64()))
    length = np.array(pc.fill_null(pc.list_value_length(column), 0))
    length[~np.array(ids.is_valid())] = 0
    out = {}
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        keys, rows = ids.take(pa.array(at)), column.take(pa.array(at)).flatten()
        x = np.where(np.array(rows.is_valid()), np.array(rows.fill_null(0)), np.nan).reshape(-1, n)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            out[int(n)] = keys.to_numpy(zero_copy_only=False)[good].astype(np.int64), x[good]
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, scales, norms of the coded vectors and of the rest."""
    with np.errstate(over="ignore"):
        big = np.abs(x).max(axis=1, keepdims=True)
        unit = x / big
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; products are added in the order of the dimensions, so that the same pair gives
    the same number wherever it is computed.  Vectors are scaled by powers of two before, which changes no digit and keeps
    squares of very large and very small numbers in range."""
    a, b = _in_range(a), _in_range(b)
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def _in_range(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Block:
    """A block of queries of one dimension, with its codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.codes, self.scale, self.norm, self.rest = coded(x)

    def tile(self, heaps: list[list], ids: np.ndarray, y: np.ndarray, k: int) -> None:
        """Take a tile of candidates into the queries' heaps of ``(score, -vec_id)``."""
        codes, scale, norm, rest = coded(y)
        # float32 holds sums of int8 products exactly up to 1,040 dimensions; longer vectors are added in float64
        kind = np.float32 if y.shape[1] <= 1000 else np.float64
        right = codes.astype(kind).T
        for lo in range(0, len(self.ids), 512):
            part = slice(lo, lo + 512)
            near = (self.codes[part].astype(kind) @ right) * (self.scale[part, None] * scale)
            error = self.norm[part, None] * rest + self.rest[part, None] * (norm + rest) + 1e-6
            upper = near + error
            lower = near - error
            own = self.ids[part, None] == ids
            lower[own] = upper[own] = -np.inf
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[part]])
            if len(np.unique(ids)) == len(ids) and lower.shape[1] > k:  # with repeated ids the k best need not differ
                floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
            del lower, error
            q, c = np.nonzero((upper >= floor[:, None]) & ~own)
            for at in range(0, len(q), 100_000):
                qs, cs = q[at : at + 100_000], c[at : at + 100_000]
                for i, j, score in zip(qs + lo, ids[cs], cosine(self.x[qs + lo], y[cs])):
                    push(heaps[i], float(score), int(j), k)


def push(heap: list, score: float, key: int, k: int) -> None:
    entry = (score, -key)
    if len(heap) == k and entry <= heap[0]:
        return
    for i, (s, other) in enumerate(heap):
        if other == -key:  # a repeated id: its nearest vector counts
            if s >= score:
                return
            heap[i] = entry
            heapq.heapify(heap)
            return
    heapq.heappush(heap, entry)
    if len(heap) > k:
        heapq.heappop(heap)


def _searched(candidates: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    def run(batches):
        heaps = {n: [[] for _ in b.ids] for n, b in blocks.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                for n, (ids, y) in vectors(part.column(0), part.column(1)).items():
                    if n in blocks:
                        blocks[n].tile(heaps[n], ids, y, k)
        for n, b in blocks.items():
            rows = [(int(q), -key, score) for q, heap in zip(b.ids, heaps[n]) for score, key in heap]
            if rows:
                q, v, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, SCHEMA)


def nearest(table: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of each query's ``k`` nearest rows of ``table``; both hold ``vec_id`` and
    ``embedding``."""
    usable = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    wanted = queries.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null").where(usable)
    wanted = materialise(wanted.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    candidates = table.select(F.col("vec_id").cast("long"), "embedding")
    parts = max(1, -(-wanted.count() // block))
    found = None
    for p in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).toArrow()
        blocks = {n: Block(*v) for n, v in vectors(rows.column(0).combine_chunks(), rows.column(1).combine_chunks()).items()}
        one = _searched(candidates, blocks, k)
        one = ranked(one, k) if parts == 1 else materialise(ranked(one, k), "nearest")
        found = one if found is None else found.unionByName(one)
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, of what the tasks have found."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def digest(table: DataFrame) -> DataFrame:
    return nearest(table, table.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
with usable as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""

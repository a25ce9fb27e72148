"""Largest inner products by a block matrix join.

Candidates and queries are dealt into blocks of at most ``block`` vectors of
one dimension; a tile is one query block against one candidate block.  Each
vector is held as int8 steps of its own scale, with the norm of what rounding
lost.  A tile's integer products are exact, so by Cauchy-Schwarz each true
product lies within a known bound of its estimate.  Per query, the k-th
largest lower bound is a bar that the k best must reach; pairs whose upper
bound is under it drop out, the rest are recomputed in double precision on the
original vectors, and a heap per query keeps the k best over the tiles a task
sees.  The heaps of all tasks are merged by rank.

Every candidate meets every query, in blocks: no index, nothing left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import prepare, table

K, BLOCK = 20, 4096


def usable(vec):
    """Vectors that take part: not null, not empty, no null or non-finite
    component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)


def _blocks(vectors: DataFrame, names: tuple[str, str, str], block: int, n_blocks: int) -> DataFrame:
    """Rows (id, vec double[]) as (dim, part, ids, data): at most ``block``
    vectors each, row-major little-endian doubles."""
    part, ids, data = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(key):
            got = held.pop(key)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array([i for i, _ in got], "<i8").tobytes()], pa.binary()), pa.array([b"".join(v for _, v in got)], pa.binary())],
                ["dim", part, ids, data])

        for b in batches:
            offs, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False).astype("<f8")
            for p, i, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), offs[:-1], offs[1:]):
                rows = held.setdefault((int(e - s), p), [])
                rows.append((i, flat[s:e].tobytes()))
                if len(rows) >= block:
                    yield out((int(e - s), p))
        for key in list(held):
            yield out(key)

    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("part"), "id", "vec").repartition(n_blocks, "part")
    return dealt.mapInArrow(run, f"dim int, {part} int, {ids} binary, {data} binary")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 steps, scale, norm of the vector, norm of what rounding lost)."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    steps = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    lost = x - steps * scale[:, None]
    return steps, scale, np.sqrt((x * x).sum(axis=1)), np.sqrt((lost * lost).sum(axis=1))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components: equal
    vectors give equal products wherever they are computed."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Tile:
    """One tile's survivors: (query row, candidate row, product)."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, qid, q, cid, c, rows: int = 512):
        qs, qscale, qnorm, qlost = quantise(q)
        cs, cscale, cnorm, clost = quantise(c)
        cf = cs.astype(np.float32).T  # integers up to 127: float32 products of them are exact below 2^24
        wide = q.shape[1] * 127 * 127 >= 1 << 24
        for r in range(0, len(q), rows):
            s = slice(r, r + rows)
            dot = (qs[s].astype(np.float64) @ cf.astype(np.float64)) if wide else (qs[s].astype(np.float32) @ cf)
            est = dot.astype(np.float64) * qscale[s, None] * cscale[None, :]
            # x.y - x^.y^ = x.(y - y^) + (x - x^).y^, and |y^| <= |y| + lost
            off = qnorm[s, None] * clost[None, :] + qlost[s, None] * (cnorm + clost)[None, :]
            off = off * (1 + 1e-9) + np.abs(est) * 1e-9 + 1e-300
            est[qid[s][:, None] == cid[None, :]] = -np.inf
            n = est.shape[1]
            low = est - off
            bar = np.partition(low, n - self.k, axis=1)[:, n - self.k][:, None] if n > self.k else np.full((len(est), 1), -np.inf)
            i, j = np.nonzero((est + off >= bar) & np.isfinite(est))
            yield i + r, j, exact_products(q[i + r], c[j])


def best_of_tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the ``k`` best of each query in each tile
    (dim, qids, q, cids, c), sent tile by tile, so a task holds the heaps of
    one query block only."""
    tile = Tile(k)
    for b in batches:
        for r in range(b.num_rows):
            best: dict[int, list] = {}
            dim = b.column(0)[r].as_py()
            qid, q, cid, c = (np.frombuffer(b.column(n)[r].as_py(), t) for n, t in ((1, "<i8"), (2, "<f8"), (3, "<i8"), (4, "<f8")))
            for i, j, s in tile(qid, q.reshape(-1, dim), cid, c.reshape(-1, dim)):
                for who, v, score in zip(qid[i].tolist(), cid[j].tolist(), s.tolist()):
                    heap = best.setdefault(who, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -v))
                    elif (score, -v) > heap[0]:
                        heapq.heapreplace(heap, (score, -v))
            rows = [(who, -v, score) for who, heap in best.items() for score, v in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of largest inner
    product of each query, ties to the smaller id, fewer if there are fewer.

    Both tables are (id long, vec array).  Unusable vectors (see ``usable``)
    and null ids take no part; a query meets only candidates of its own
    dimension and never the candidate with its own id.  Repeated candidate
    rows (same id) count once per row.  Pairs whose product or its bound is no
    finite number (components near 1e150 and more) are left out.  Other
    columns, whatever their names, are not read.  Empty tables give an empty
    result.
    """
    spark = candidates.sparkSession
    prepare(spark)
    # one multiplication per product: the cast to double comes first
    take = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    queries, candidates = take(queries), take(candidates)
    parts = [max(1, -(-df.count() // block)) for df in (queries, candidates)]
    q = _blocks(queries, ("qpart", "qids", "q"), block, parts[0])
    c = _blocks(candidates, ("cpart", "cids", "c"), block, parts[1])
    # the query set goes to every candidate part, a block at a time
    sent = q.withColumn("cpart", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))))
    tiles = sent.hint("merge").join(c, ["dim", "cpart"])

    found = tiles.select("dim", "qids", "q", "cids", "c").mapInArrow(lambda it: best_of_tiles(it, k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector; edge cases as in ``nearest``."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(e.where("id % 20 = 0"), e)


OP7_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as score
  from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""

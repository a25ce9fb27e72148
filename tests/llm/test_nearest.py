"""Block matrix join against all products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare, duck
from recensio.llm import nearest as M

SCHEMA = "id long, vec array<float>"


def brute(queries, candidates, k):
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v)
    out = []
    for i, q in queries:
        if i is None or not good(q):
            continue
        q = np.asarray(q, np.float32).astype(float)
        s = []
        for j, c in candidates:
            if j is not None and j != i and good(c) and len(c) == len(q):
                t = 0.0
                for a, b in zip(q, np.asarray(c, np.float32).astype(float)):
                    t += a * b
                s.append((-t, j))
        out += [(i, r + 1, j, -t) for r, (t, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def ours(spark, queries, candidates, **kw):
    extra = {"part": F.lit("x"), "dim": F.lit(0), "score": F.lit(None).cast("int"), "rank": F.lit(1)}  # names of its own columns
    got = M.nearest(spark.createDataFrame(queries, SCHEMA).withColumns(extra), spark.createDataFrame(candidates, SCHEMA).withColumns(extra), **kw).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_tiles_are_sent_one_by_one():
    rng = np.random.default_rng(4)
    taken = []

    def tiles():
        for n in range(3):
            taken.append(n)
            q, c = rng.normal(size=(5, 4)), rng.normal(size=(30, 4))
            cells = [pa.array([v]) for v in (4, np.arange(5).tobytes(), q.tobytes(), np.arange(100 * n + 100, 100 * n + 130).tobytes(), c.tobytes())]
            yield pa.RecordBatch.from_arrays(cells, ["dim", "qids", "q", "cids", "c"])

    for n, out in enumerate(M.best_of_tiles(tiles(), 3)):
        assert taken == list(range(n + 1)) and out.num_rows == 15  # no tile waits for the next
    assert n == 2


@pytest.mark.parametrize("block", [7, 4096])
def test_against_all_products(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, (base[i % 40] * (1 if i % 7 else 1000)).tolist()) for i in range(90)]  # copies: ties
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] * 8), (205, [None] + [1.0] * 7), (None, [1.0] * 8),
             (300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [1e-30] * 8), (303, [1e30] * 8)]
    queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
    assert ours(spark, queries, rows, k=6, block=block) == brute(queries, rows, 6)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert ours(spark, rows, rows, k=20) == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert ours(spark, [], rows) == [] and ours(spark, rows, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(20, 64)) * 10.0 ** rng.integers(-3, 3, (20, 1)), rng.normal(size=(300, 64))
    (qs, qa, qn, ql), (cs, ca, cn, cl) = M.quantise(q), M.quantise(c)
    est = (qs.astype(float) @ cs.astype(float).T) * qa[:, None] * ca[None]
    assert (np.abs(est - q @ c.T) <= qn[:, None] * cl[None] + ql[:, None] * (cn + cl)[None] + 1e-9).all()


def test_driver_vectors(spark):
    d = "/root/testdata/sf0.01"
    ok, why = compare(M.op7_nearest_blocks(spark, d), duck(d), M.OP7_SQL)
    assert ok, why

"""Hard negatives against all products, computed plainly."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare, duck
from recensio.llm import negatives as M

SCHEMA = "id long, label int, vec array<float>"


def brute(rows, step, positives=5, negatives=3):
    live = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)}
    out = []
    for i, lab, a in live:
        if i % step:
            continue
        score = [(-s, j, same) for j, l2, c in live if j != i and len(c) == len(a) for s, same in [(sum(x * y for x, y in zip(a, c)), l2 == lab)] if abs(s) < 1 << 62]
        for p, j, _ in sorted(x for x in score if x[2])[:positives]:
            fit = sorted(x for x in score if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def ours(spark, rows, step, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"row": F.lit(1), "cl": F.lit("x"), "score": F.lit(0)})
    return sorted(tuple(r) for r in M.hard_negatives(df, F.col("id") % step == 0, **kw).collect())


def vectors(seed, n, dim=8, groups=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return [(i, int(rng.integers(3)), (centre[rng.integers(groups)] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LIST", 11), ("MEMBERS", 7), ("FIRST", 1), ("GROWTH", 2), ("RUN", 2)):
        monkeypatch.setattr(M, name, value)


def test_against_all_products(spark, small):
    rows = vectors(3, 300)
    assert ours(spark, rows, 4) == brute(rows, 4)


def test_odd_rows(spark, small):
    rows = vectors(4, 90)
    hot = rows[0][2]
    rows += [(1000 + i, i % 2, hot) for i in range(60)]  # copies: ties
    rows += [rows[5], rows[5], (rows[5][0], 9, rows[7][2]), (rows[8][0], rows[8][1], rows[9][2])]  # repeated rows, shared ids
    rows += [(2000, None, hot), (2004, 1, None), (2008, 1, [float("nan")] + hot[1:]), (2012, 1, [None] + hot[1:]), (2016, 1, [float("inf")] + hot[1:]), (None, 1, hot)]
    rows += [(3000 + i, i % 2, [0.0] * 8) for i in range(9)] + [(4000 + i, i % 2, []) for i in range(8)]
    rows += [(5000 + i, i % 3, [float(i), 1.0]) for i in range(20)] + [(6000 + i, i % 2, [1e6 * (i + 1), 3e5, 1.0]) for i in range(12)]
    rows += [(7000 + i, i % 2, [1e30, 1e20 * i] + [0.5] * 3) for i in range(6)] + [(-4, 1, hot)]
    assert ours(spark, rows, 4) == brute(rows, 4)
    assert ours(spark, rows, 4, sample=3) == brute(rows, 4)


def test_hot_vector_and_one_label(spark):
    rows = vectors(5, 60) + [(100 + i, 1, [1.0] * 8) for i in range(400)]
    assert ours(spark, rows, 10) == brute(rows, 10)
    assert ours(spark, [(i, 1, v) for i, _, v in rows], 10) == []


def test_empty(spark):
    assert ours(spark, [], 4) == [] and ours(spark, [(1, 1, [1.0])], 4) == [] and ours(spark, [(4, 1, [1.0])], 4) == []


def test_bounds_hold_for_all_members():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-300, 300, (50, 16)).astype(float), rng.integers(-300, 300, (400, 16)).astype(float)
    c = M.Clusters({16: np.array([v / np.linalg.norm(v) for v in a[:4]])})
    home = [c.home(v) for v in a]
    radius = {k: min(cos for h, cos in home if h == k) for k in {h for h, _ in home}}
    for v in x:
        bound = dict(c.bounds(v, radius))
        assert all(u @ v <= np.linalg.norm(u) * bound[h] + 1e-6 for u, (h, _) in zip(a, home))


def test_members_leave_early(spark):
    """Lists ordered by bound: far candidates are never multiplied."""
    rng = np.random.default_rng(2)
    near = [(i, i % 2, (np.eye(4)[0] * 3 + 0.05 * rng.normal(size=4)).tolist()) for i in range(0, 60)]
    rows = M.usable(spark.createDataFrame(near + [(100 + i, i % 2, (-np.eye(4)[0]).tolist()) for i in range(200)], SCHEMA))
    anchors = rows.where("id % 50 = 0 and id < 60").withColumn("row", F.monotonically_increasing_id())
    clusters = M.Clusters(M.fit_centres(anchors))
    members = M.members_of(anchors, clusters).withColumn("pos", F.array(F.lit(-1).cast("long")))
    radius = {r.cl: r.cos for r in members.groupBy("cl").agg(F.min("cos").alias("cos")).collect()}
    lists = M.sorted_lists(rows, clusters, radius, 20)
    top = max(r.norm for r in members.collect())
    after = [r.hi for r in lists.orderBy("b").collect()]
    assert after == sorted(after, reverse=True) and top * after[-1] < 256 * 256


def test_driver_vectors(spark):
    d = "/root/testdata/sf0.1"
    ok, why = compare(M.op11_hard_negatives(spark, d), duck(d), M.OP11_SQL)
    assert ok, why

"""k-means of many companies: plans, layouts, fixed points."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators import features as FT
from recensio.operators import kmeans as KM
from recensio.operators import topics as TP

SCHEMA = "company string, seq bigint, parole array<string>"


def corpus(spark, seed=3):
    """Three companies with their own words and colliding review numbers, a
    small one, one without a vocabulary, some reviews without any term."""
    rnd = random.Random(seed)
    rows = []
    for c, n in (("a", 90), ("b", 40), ("c", 7)):
        words = [f"{c}parola{chr(97 + i)}" for i in range(14)]
        rows += [(c, s, [rnd.choice(words[(s % 3) * 4:(s % 3) * 4 + 6]) for _ in range(6)] if s % 11 else ["è"]) for s in range(n)]
    rows += [("few", s, ["pacco", "corriere"]) for s in range(4)] + [("own", s, [f"unico{chr(97 + s)}"]) for s in range(9)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(df, cfg, k=None):
    out = TP.assign_topics(df, k, cfg)
    return {(r.company, r.seq): r.cluster for r in out[0].collect()}, out


CFG = Config(n_init=3, kmeans_max_iter=40)
SHORT = dict(n_init=2, kmeans_max_iter=6)


def test_both_plans_and_any_layout_agree(spark, monkeypatch):
    monkeypatch.setattr(KM, "BLOCK", 16)
    df = corpus(spark)
    want, _ = labels(df, Config(**SHORT))
    for layout in (df.coalesce(1), df.repartition(4), df.repartition(16, "seq").sortWithinPartitions(F.desc("seq"))):
        assert labels(layout, Config(**SHORT))[0] == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for rows, broadcast, parts in ((0, 0, "3"), (39, 1 << 26, before)):  # all in rounds, joined by shuffle; the larger two in rounds
        monkeypatch.setattr(KM, "BROADCAST", broadcast)
        try:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert labels(df.repartition(5), Config(**SHORT, kmeans_rows=rows))[0] == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all((v is None) == (c in ("few", "own")) for (c, _), v in want.items()) and len(want) == 150


def test_labels_are_a_fixed_point(spark):
    df = corpus(spark)
    got, (_, centroids, vocab, k) = labels(df, CFG, 4)
    dicts = FT.dictionaries(df, CFG)
    vec = {(r.company, r.seq): r for r in TP.topic_vectors(df, dicts, 4).collect()}
    cents = {}
    for r in centroids.collect():
        cents.setdefault(r.company, {})[r.cluster] = np.round(np.array(r.weights) * KM.UNIT)
    assert set(cents) == {"a", "b", "c"} and k == 4 and vocab.select("company").distinct().count() == 3
    for company, c in cents.items():
        mine = {key: KM.dense(np.array([0, len(v.idx)]), np.array(v.idx, int), np.array(v.val), v.dim)[0] for key, v in vec.items() if key[0] == company}
        for key, x in mine.items():
            d = [((x - c[t]) ** 2).sum() for t in sorted(c)]
            assert got[key] == int(np.argmin(d))
        for t, w in c.items():
            members = [x for key, x in mine.items() if got[key] == t]
            if members:
                assert (np.floor((2 * np.sum(members, axis=0) + len(members)) / (2 * len(members))) == w).all()


def test_best_start_is_no_worse_than_any(spark):
    df = corpus(spark, 9)
    vectors = TP.topic_vectors(df, FT.dictionaries(df, CFG), 4)
    blocks = KM.Blocks(vectors)
    costs = {r.start: r.c for r in KM.lloyd(blocks, KM.seeds(blocks, CFG), 3, 40).where("company = 'a'").groupBy("start").agg(F.max("cost").alias("c")).collect()}
    label = {(r.company, r.seq): r.cluster for r in KM.kmeans(vectors, CFG)[0].collect()}
    rows = [r for r in vectors.collect() if r.company == "a"]
    x = np.stack([KM.dense(np.array([0, len(r.idx)]), np.array(r.idx, int), np.array(r.val), r.dim)[0] for r in rows])
    own = np.array([label["a", r.seq] for r in rows])
    spread = sum(((x[own == t] - x[own == t].mean(axis=0)) ** 2).sum() for t in set(own.tolist()))
    assert len(costs) == 3 and spread <= min(costs.values()) * (1 + 1e-6)


def test_race_picks_by_squared_distance():
    """Times are exponential, and the winner's chance is in proportion."""
    rng = np.random.default_rng(1)
    t = KM.race_times(rng.integers(0, KM.PRIME, 200_000), 42, 0, 1)
    assert abs(t.mean() - 1) < 0.02 and abs((t > 1).mean() - np.exp(-1)) < 0.01
    wins = np.zeros(3)
    weight = np.array([1.0, 2.0, 5.0])
    for start in range(4000):
        wins[(KM.race_times(np.array([11, 22222, 987654321]), 42, start, 0) / weight).argmin()] += 1
    assert np.abs(wins / wins.sum() - weight / weight.sum()).max() < 0.03


def test_company_vectors_against_plain_counts(spark):
    df = corpus(spark, 4)
    dicts = {r.company: r for r in FT.dictionaries(df, CFG).collect()}
    rows = df.collect()
    for company, d in dicts.items():
        mine = [r.parole for r in rows if r.company == company]
        df_of = {t: sum(t in p for p in mine) for p in mine for t in p if t.isascii() and len(t) >= 3}
        kept = sorted(t for t, n in df_of.items() if 2 <= n <= 0.8 * len(mine))
        assert d.n == len(mine) and d.terms == kept and d.dfs == [df_of[t] for t in kept] and d.cfs == [sum(p.count(t) for p in mine) for t in kept]
    for r in FT.company_vectors(df, FT.dictionaries(df, CFG)).collect():
        d = dicts[r.company]
        parole = next(x.parole for x in rows if (x.company, x.seq) == (r.company, r.seq))
        w = np.array([parole.count(t) * i for t, i in zip(d.terms, d.idfs)])
        n = np.sqrt((w * w).sum())
        assert r.idx == np.flatnonzero(w).tolist() and np.allclose(r.w, w[r.idx] / n if n else [])


@pytest.mark.parametrize("k", [None, 3])
def test_topic_rows_are_each_companys_own(spark, k):
    df = corpus(spark).withColumns({"review_id": F.concat("company", F.lit("-"), "seq"), "testo": F.lit("t"), "rating": F.lit(4), "data": F.lit(None).cast("string"), "link": F.lit("l")})
    labelled, centroids, vocab, most = TP.assign_topics(df, k, CFG)
    rows = TP.topic_rows(labelled, centroids, vocab, most, CFG).collect()
    by = {c: sorted(r.id for r in rows if r.company == c) for c in ("a", "b", "c", "few", "own")}
    assert by["few"] == by["own"] == [] and by["a"] == list(range(k or 8)) and by["b"] == list(range(k or 4)) and by["c"] == list(range(3))
    for r in rows:
        assert all(w.startswith(f"{r.company}parola") for w in r.parole_chiave)
    one = df.where("company = 'b'").drop("company")
    alone = TP.topic_rows(*TP.assign_topics(one, k, CFG), CFG).collect()
    assert "company" not in alone[0].__fields__ and sum(r.n_recensioni for r in alone) == 40

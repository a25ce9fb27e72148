"""k-means invariants and the per-topic operators on own fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators import topics as TP

GROUPS = [
    ["spedizione", "corriere", "pacco", "consegna", "ritardo"],
    ["prezzo", "sconto", "offerta", "costo", "risparmio"],
    ["assistenza", "operatore", "telefono", "risposta", "cortesia"],
]


def _corpus(spark, per_group=20, seed=7):
    rnd = random.Random(seed)
    rows = []
    seq = 0
    for g, words in enumerate(GROUPS):
        for _ in range(per_group):
            parole = [rnd.choice(words) for _ in range(8)] + ["negozio"]
            rows.append((seq, f"id{seq}", " ".join(parole), parole, 1 + seq % 5, g))
            seq += 1
    return spark.createDataFrame(rows, "seq bigint, review_id string, testo string, parole array<string>, rating int, g int")


@pytest.fixture(scope="module")
def fitted(spark):
    cfg = Config(n_init=3, kmeans_max_iter=50)
    r = _corpus(spark)
    labelled, cents, vocab, k = TP.assign_topics(r, 3, cfg)
    return r, labelled.orderBy("seq").collect(), cents.collect(), k, cfg


def test_labels_in_range_and_sizes_sum(fitted):
    r, rows, _, k, _ = fitted
    assert k == 3
    assert all(0 <= x.cluster < k for x in rows)
    assert len(rows) == r.count()


def test_separable_groups_recovered(fitted):
    _, rows, _, _, _ = fitted
    by_group = {}
    for x in rows:
        by_group.setdefault(x.g, set()).add(x.cluster)
    assert all(len(v) == 1 for v in by_group.values())
    assert len({next(iter(v)) for v in by_group.values()}) == 3


def test_each_row_nearest_to_its_centroid(spark, fitted):
    from recensio.operators import features as FT
    r, rows, cents, _, cfg = fitted
    vocab = FT.vocab_rows(FT.vocabulary(r, cfg))
    vec = {x.seq: x.features.toArray() for x in FT.with_vectors(r, vocab).select("seq", "features").collect()}
    centers = {c.cluster: c.weights for c in cents}
    for x in rows:
        d = {c: sum((a - b) ** 2 for a, b in zip(vec[x.seq], w)) for c, w in centers.items()}
        assert d[x.cluster] <= min(d.values()) + 1e-9


def test_same_seed_same_labels(spark, fitted):
    r, rows, _, _, cfg = fitted
    again = TP.assign_topics(r, 3, cfg)[0].orderBy("seq").collect()
    assert [x.cluster for x in again] == [x.cluster for x in rows]


def test_guard_fewer_than_five(spark):
    r = _corpus(spark).limit(4)
    labelled, _, _, k = TP.assign_topics(r, None, Config())
    assert k == 0 and all(x.cluster is None for x in labelled.collect())


def test_auto_k(spark):
    df = spark.createDataFrame([(n,) for n in (5, 29, 30, 79, 80, 10000)], "n int")
    assert [x[0] for x in df.select(TP.auto_k(F.col("n"))).collect()] == [3, 3, 3, 7, 8, 8]


def _greedy(rows, k, per):
    """Plain model: topics by id, reviews in order, skip used identities."""
    used, out = set(), []
    for c in range(k):
        n = 0
        for seq, ident in sorted((s, i) for cl, s, i in rows if cl == c):
            if n < per and ident not in used:
                used.add(ident)
                out.append((c, seq))
                n += 1
    return sorted(out)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 16), (4, 5)])
def test_topic_examples_crossing_identities(spark, seed, parts):
    rnd = random.Random(seed)
    k = 4
    rows = [(rnd.randrange(k), s, f"id{rnd.randrange(12)}") for s in range(80)]
    df = spark.createDataFrame(
        [(c, s, i, "t", 3, None, "l") for c, s, i in rows],
        "cluster int, seq bigint, review_id string, testo string, rating int, data string, link string").repartition(parts)
    got = sorted((x.id, x.seq) for x in TP.topic_examples(df, k, Config()).collect())
    assert got == _greedy(rows, k, 3)


def test_topic_summary_empty_topic(spark):
    df = spark.createDataFrame([(0, 5), (0, 0), (2, None)], "cluster int, rating int")
    s = {x.id: x for x in TP.topic_summary(df, 3).collect()}
    assert s[1].n_recensioni == 0 and s[1].rating_medio is None
    assert s[0].rating_medio == 5.0 and abs(s[0].percentuale - 200 / 3) < 1e-9


def test_fewer_distinct_vectors_than_k(spark):
    rows = [(i, f"id{i}", "x", ["pacco", "corriere"] if i % 2 else ["prezzo", "sconto"], 5) for i in range(12)]
    r = spark.createDataFrame(rows, "seq bigint, review_id string, testo string, parole array<string>, rating int")
    labelled, cents, _, k = TP.assign_topics(r, 5, Config(n_init=2, kmeans_max_iter=20, min_df=1, max_df=1.0))
    assert k == cents.count() <= 2
    assert all(0 <= x.cluster < k for x in labelled.collect())


def test_empty_vocabulary_guard(spark):
    rows = [(i, f"id{i}", "x", [f"unico{i}"], 5) for i in range(8)]  # every term in one review only
    r = spark.createDataFrame(rows, "seq bigint, review_id string, testo string, parole array<string>, rating int")
    labelled, cents, vocab, k = TP.assign_topics(r, None, Config())
    assert k == 0 and cents.count() == 0 and vocab.count() == 0
    assert all(x.cluster is None for x in labelled.collect())

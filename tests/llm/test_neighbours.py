"""Neighbour voting: exact cosines, held-out accuracy, edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recensio.llm import neighbours as N


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, N.fit_voters(docs, labels, keep=~N.held_out(F.col("doc_id")))


def test_one_document_per_labelled_id(spark, make_docs):
    rows = [(1, f"text {i} of one id " * 5) for i in range(60)] + [(1, "text 0 of one id " * 5)] * 60 + [(i, f"word{i} other " * 9) for i in range(2, 12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    a, b = (N.fit_voters(make_docs(r), labels) for r in (rows, rows[::-1]))
    assert len(a.labels) == 11 and sorted(a.labels) == sorted(b.labels) and np.allclose(a.vectors, b.vectors, atol=1e-4)


def test_long_texts_are_weighed_alike_in_fit_and_score(spark, make_docs):
    texts = ["a" * 3_000_000 + " xyz" * 50_000, "a" * 1000, "xyz " * 100, "some other words " * 40]
    voters = N.fit_voters(make_docs(list(enumerate(texts))), spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, quality int"))
    assert (voters.embed(N._matrix(texts[:1])) @ voters.vectors.T).max() > 0.9999


def test_document_frequencies(spark, sf_texts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df, n = N.document_frequencies(docs.repartition(3))
    want = (np.stack([N.term_counts(t) for t in sf_texts.values()]) > 0).sum(axis=0)
    assert n == len(sf_texts) and (df == want).all()


def test_held_out_accuracy(fitted):
    docs, labels, voters = fitted
    got = {r.doc_id: r.score for r in N.quality_votes(docs, voters).collect()}
    want = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == docs.count() and len(want) > 50
    assert sum((s >= 0.5) == q for q, s in want) / len(want) > 0.95


def test_scores_are_brute_force_votes(fitted, sf_texts):
    voters = fitted[2]
    texts = list(sf_texts.values())[:40]
    got = voters.score(N._matrix(texts))
    for t, s in zip(texts, got):
        v = np.log1p(N.term_counts(t)) * voters.idf
        v = v / np.linalg.norm(v) @ voters.axes
        cos = voters.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos)[: voters.nearest]
        w = np.maximum(cos[near], 0).astype(float) ** N.POWER
        assert abs((w @ voters.labels[near]) / w.sum() - s) < 1e-3


def test_edges(make_docs, fitted):
    docs, labels, voters = fitted
    rows = [(1, None), (2, ""), (None, "ab"), (3, "same text here"), (3, "same text here"), (4, "x" * 200_000)]
    got = N.quality_votes(make_docs(rows).withColumnRenamed("source", "score"), voters).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 3, 3, 4] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == voters.prior and got[3].score == got[4].score
    assert N.quality_votes(make_docs([]), voters).count() == 0
    none = N.fit_voters(make_docs(rows), labels.where("false"))
    assert N.quality_votes(make_docs(rows), none).first().score == 0.5

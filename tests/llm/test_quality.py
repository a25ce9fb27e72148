"""Quality rules: counts against plain definitions, trees on known data."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from recensio.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def test_counts_on_odd_texts(sf_texts):
    rng = random.Random(2)
    odd = ["".join(rng.choices("ab #\n\t\x0b\x0c\r\x1c\x85  é|", k=rng.randint(0, 120))) for _ in range(400)]
    odd += ["a b c d e a b c d e", "x " * 50, "", "\n\n", "a b c d e f " * 3 + "a b c d e"]
    for t in [*odd, *sf_texts.values()]:
        assert Q.counts(t)[:5] == plain(t), repr(t)[:200]


def test_repeats_with_many_distinct_words():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 60_000, 5000)
    ids[4000:4100] = ids[100:200]
    u, ids = np.unique(ids, return_inverse=True)
    words = ids.tolist()
    n = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if n[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    assert Q.repeated_words(ids, 1 << 40) == Q.repeated_words(ids, len(u)) == len(hit) == 200


def test_trees_follow_monotone_direction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(12 * x[:, 0]) - x[:, 1] + rng.normal(0, 0.2, 3000)) > 0).astype(float)
    m = Q.fit_trees(x, y, [1, -1, 0])
    grid = np.linspace(0, 1, 101)
    for j, d in ((0, 1), (1, -1)):
        z = np.repeat(rng.random((40, 1, 3)), 101, axis=1)
        z[:, :, j] = grid
        s = m.score(z.reshape(-1, 3)).reshape(40, 101)
        assert ((np.diff(s, axis=1) * d) >= -1e-12).all()
    assert ((m.score(x) >= 0.5) == y).mean() > 0.8


@pytest.fixture(scope="module")
def sf(spark):
    d = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out(sf):
    docs, labels = sf
    model = Q.fit_quality(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in Q.quality_rules(docs, model).select("row.doc_id", "score").collect()}
    want = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 3 = 1").collect()]
    assert sum((s >= 0.5) == q for q, s in want) / len(want) > 0.95


def test_one_document_per_labelled_id(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit_trees", lambda x, y, *rest: seen.append(len(x)))
    rows = [(1, f"text {i} of one id " * 5) for i in range(60)] + [(1, "copy")] * 60 + [(2, None), (3, "other")]
    Q.fit_quality(make_docs(rows), spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int"))
    assert seen == [3]


def test_edges(make_docs, sf):
    docs, labels = sf
    model = Q.fit_quality(docs, labels)
    rows = [(1, None), (2, ""), (None, "word " * 12), (3, "one two three four five six seven eight nine ten."), (3, "one two three four five six seven eight nine ten."), (4, "w" * 100_000)]
    odd = make_docs(rows).withColumnRenamed("source", "counts").withColumnRenamed("lang", "score")
    got = Q.quality_rules(odd, model).collect()
    assert [r.row.doc_id for r in got] == [1, 2, None, 3, 3, 4] and got[0].row["counts"] == "s"
    assert [r.base_failed for r in got] == [True, True, True, False, False, True]
    assert got[3].kept == got[4].kept
    assert Q.quality_rules(make_docs([]), model).count() == 0
    none = Q.fit_quality(docs, labels.where("false"))
    assert Q.quality_rules(make_docs(rows[3:4]), none).first().kept  # a constant score rejects nothing

"""Ranked search against scores computed plainly for every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oracle import compare, duck
from recensio.llm import lexical as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        got = []
        for i, tf, n in held:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(got, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ours(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({"score": F.lit(1), "no": F.lit("x"), "terms": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(7), "df": F.lit(0)})
    return sorted((tuple(r) for r in M.ranked_search(d, i, **kw).collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCS", 60)
    monkeypatch.setattr(M, "BLOCK", 4)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Zürich", "ZÜRICH", "東京", "a_b", "x9"]
    docs = [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(0.8)) + 1))) for i in range(n)]
    docs += [(i % 7, docs[i % 20][1]) for i in range(40)]  # shared ids and texts: ties
    docs += [(500, None), (501, ""), (502, " .,;\n"), (None, docs[3][1]), (None, docs[4][1]), (600, "w1 " * 5000 + "rare")]
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for j in range(25)] + [(3, "rare w1"), (90, None), (91, "..."), (92, "unseen"), (None, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_plain_scores(spark, small, k):
    docs, items = corpus(5, 700)
    assert ours(spark, docs, items, k=k) == brute(docs, items, k)


def test_all_terms_indexed_and_several_passes(spark, small):
    docs, items = corpus(6, 150)
    assert ours(spark, docs, items, k=4, vocabulary=3, batch_terms=40) == brute(docs, items, 4)


def test_blocks_are_left_closed(spark):
    """With a high bar the non-essential blocks stay compressed."""
    docs = [(i, "common " * (1 + i % 3) + ("rare" if i == 77 else "")) for i in range(2000)]
    row = M.inverted_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), ["common", "rare"]).first().asDict()
    s = M.Shard(row, row["n_docs"], row["n_terms"])
    doc, _ = M.search_shard(s, M.np.array([0, 1]), M.np.array([1, 5000]), int(5000 * s.list_max[1] * 0.9), 1)
    assert doc.tolist() == [77] and len(s.opened) == 2 < len(s.n)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert ours(spark, [], items) == [] and ours(spark, docs, []) == [] and ours(spark, [(1, None)], items) == []


def test_driver_tables(spark):
    d = "/root/testdata/sf0.01"
    ok, why = compare(M.op12_ranked_search(spark, d), duck(d), M.OP12_SQL)
    assert ok, why

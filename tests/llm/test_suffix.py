"""Repeated-substring removal against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recensio.llm import suffix


def brute(rows, threshold):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s:s + threshold] for _, d in data for s in range(len(d) - threshold + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - threshold + 1):
            if seen[d[s:s + threshold]] > 1:
                gone[s:s + threshold] = b"\1" * threshold
        spans = sum(1 for k, v in enumerate(gone) if v and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, v in zip(d, gone) if not v)).hexdigest()))
    return sorted(out, key=repr)


def ours(docs, **kw):
    got = suffix.remove_repeats(docs, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_against_all_windows(make_docs, crowd):
    rng = random.Random(5)
    passage, line = words(rng, 80), "the same line again and again and again. "
    rows = [(i, words(rng, rng.randint(0, 200))) for i in range(30)]
    rows += [(100 + i, words(rng, 20) + passage + words(rng, 30)) for i in range(6)]  # a shared passage, other neighbours
    rows += [(200 + i, passage[i * 7:] + passage) for i in range(4)]
    rows += [(300, line * 30), (301, line * 9 + words(rng, 50)), (302, "a" * 1000), (303, "ab" * 400 + words(rng, 60) + "ab" * 100)]
    rows += [(400, None), (401, ""), (402, "x" * 199), (403, "y" * 200), (404, "z" * 201), (405, "é" * 150)]
    rows += [(500, words(random.Random(9), 90)), (500, words(random.Random(9), 90)), (501, words(random.Random(8), 90)), (501, words(random.Random(7), 90))]
    rows += [(None, words(random.Random(6), 90)), (None, None)]
    near = words(rng, 300)
    rows += [(600 + i, near[:200 * i] + "#" + near[200 * i + 1:]) for i in range(8)]
    assert ours(make_docs(rows), crowd=crowd) == brute(rows, 200)


def test_rows_that_share_an_id_are_apart(spark, make_docs):
    # two texts of one 32-bit hash (Spark's murmur3) and no id: each has a
    # repeated passage, at another place
    rng = random.Random(12)
    passage = words(rng, 90)
    texts = [f"{words(rng, 60)} {passage} {i}" for i in range(8)]
    near = spark.createDataFrame([(i,) for i in range(400_000)], "i int").selectExpr("i", "concat(repeat('q', 250), i) as t")
    far = spark.createDataFrame([(i, texts[i % 8] + f" {i}") for i in range(80_000)], "i int, t string")
    pair = near.join(far.withColumnsRenamed({"i": "j", "t": "u"}), F.expr("hash(cast(t as binary)) = hash(cast(u as binary))")).orderBy("i", "j").limit(1).collect()
    assert pair
    rows = [(None, pair[0].t), (None, pair[0].u), (1, passage), (None, pair[0].u), (None, pair[0].u)]
    assert ours(make_docs(rows)) == brute(rows, 200)


def test_spans_of_copies_stay_apart(spark, make_docs):
    rng = random.Random(13)
    rows = [(7, words(rng, 120))] * 40 + [(None, "copy of no id " * 30)] * 40
    assert ours(make_docs(rows)) == brute(rows, 200)
    spans = suffix.repeated_spans(suffix._numbered(make_docs(rows), "doc_id", "text", []), suffix.Scratch(spark))
    assert spans.select("row").distinct().count() == len(rows)  # a group a row, of that row's spans only


def test_long_text_in_chunks(make_docs, monkeypatch):
    rng = random.Random(1)
    base = words(rng, 30_000)
    rows = [(1, base), (2, words(rng, 50) + base[20_000:160_000] + words(rng, 50)), (3, base[130_000:131_500])]
    assert ours(make_docs(rows)) == brute(rows, 200)


def test_driver_documents(spark, sf_texts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ours(docs) == brute(list(sf_texts.items()), 200)


def test_empty_and_carried_columns(make_docs):
    assert ours(make_docs([])) == []
    out = suffix.remove_repeats(make_docs([(1, "a" * 500)]).withColumnRenamed("source", "h"), carry=("h", "lang")).collect()
    assert out[0].rest.asDict() == {"h": "s", "lang": "en"} and bytes(out[0].kept) == b""

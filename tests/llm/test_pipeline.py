"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from recensio.llm import pii, quality
from recensio.llm.tokens import default_path
from test_packing import check_layout
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_stages(texts, model):
    docs = dict(texts)
    c = {i: np.array([quality.counts(t or "")]) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not quality.base_failed(c[i])[0] and model.score(quality.features(c[i]))[0] >= 0.5}
    yield docs
    docs = {i: docs[i] for i, _, low in plain_components([(i, plain_fingerprint(t)) for i, t in docs.items()], 2) if i == low}
    yield docs
    rows = list(docs.items())
    data = {i: t.encode() for i, t in rows}
    seen = Counter(d[s:s + 200] for d in data.values() for s in range(len(d) - 199))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for s in range(len(d) - 199):
            if seen[d[s:s + 200]] > 1:
                gone[s:s + 200] = b"\1" * 200
        out[i] = bytes(b for b, v in zip(d, gone) if not v).decode("utf-8", "ignore")
    docs = out
    yield docs
    docs = {i: pii.replace(t, "k")[0] for i, t in docs.items()}
    yield docs


@pytest.fixture(scope="module")
def stages(spark):
    spark.conf.set(pii.KEY_CONF, "k")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, stages, sf_texts):
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for (name, _), got, want in zip(C.STAGES, stages, plain_stages(sf_texts, model)):
        assert got.columns == COLUMNS, name
        rows = got.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want), name
        assert all(r.n_chars == len(r.text) for r in rows), name


def test_packing_and_run(spark, stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    library = Tokenizer.from_file(default_path())
    want = []
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(zip(at, at[1:]))]
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    got = stages[4].collect()
    assert sorted(map(key, got)) == sorted(want)
    check_layout([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert sorted(map(key, C.run(spark, SF).collect())) == sorted(want)


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "word one two three four five six seven eight nine ten"), (3, "é" * 300), (4, "é" * 300)]
    extra = make_docs(rows).withColumns({"row": F.col("lang"), "_null": F.col("source")})
    for name, stage in C.STAGES[:4]:
        assert stage(spark, make_docs([]), SF).count() == 0, name
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        out.collect()
    assert C.STAGES[4][1](spark, make_docs([]), SF).count() == 0
    left = {r.doc_id: r.text for r in C.repeated_substrings(spark, extra, SF).collect()}
    assert left[1] is None and left[3] == left[4] == ""

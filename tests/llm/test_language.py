"""Language codes: code distances, held-out accuracy, odd texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recensio.llm import language as M

WORDS = {"aa": "kor tal men sib vad", "bb": "que los mas por una", "cc": "ght the and ing with", "dd": "東京 大阪 日本 漢字"}


def corpus(langs=tuple(WORDS), n=60, seed=3):
    rng = np.random.default_rng(seed)
    return [(i * len(langs) + k, " ".join(rng.choice(WORDS[lang].split(), 12)), lang) for i in range(n) for k, lang in enumerate(langs)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [2, 3, 4, 8, 9, 40])
def test_codewords(n):
    m = M.codewords(n).astype(int)
    apart = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (2 ** (n - 2) if n <= 8 else 4) and (abs(m.sum(axis=0)) < n).all()


def test_a_wrong_bit_is_corrected():
    m = M.Identifier([str(i) for i in range(4)], M.codewords(4), np.zeros((M.TERMS, 7), np.float32), None, np.full((4, 7), 1 / 7))
    for k in range(4):
        for bit in range(7):
            m.shift = (m.code[k] * np.where(np.arange(7) == bit, -2.0, 2.0)).astype(np.float32)
            best, p, _ = m.predict(np.zeros((1, M.TERMS), np.int64))
            assert best[0] == k and p[0] > 0.5
    m.shift = np.zeros(7, np.float32)
    assert m.predict(np.zeros((1, M.TERMS), np.int64))[2][0]  # nothing known: ambiguous


def test_features_against_a_plain_count():
    text = "Ab, ÇA 12 b_x½"
    b = " ab ça b x½ ".encode()
    want = np.zeros(M.TERMS, int)
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            want[(int.from_bytes(b[i:i + n], "big") * int(M._MIX[n - 2]) & 0xFFFFFFFF) >> (32 - M.BITS_HASHED)] += 1
    assert (M.features(text) == want).all()
    assert all(M.features(t) is None for t in (None, "", "12 +-_", "½ ²", "\n"))


def test_predicts_and_flags(spark):
    rows = corpus()
    model = M.fit_identifier(frame(spark, rows))
    new = corpus(seed=9, n=20)
    odd = [(None, new[0][1], None), (5, None, "aa"), (5, "", "aa"), (6, "42 !", "bb"), (7, "tal men " * 300_000, None), (8, "kor tal que los", None)]
    got = M.identify(frame(spark, new + odd).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)}), model).collect()
    assert [r.lang_pred for r in got[: len(new)]] == [x[2] for x in new] and all(0 <= r.score <= 1 for r in got)
    rest = got[len(new):]
    assert [r.lang_pred for r in rest[:5]] == ["aa", "und", "und", "und", "aa"] and [r.score for r in rest[1:4]] == [0, 0, 0] and rest[0].doc_id is None
    assert rest[5].score < min(r.score for r in got[: len(new)])


def test_few_languages_and_none(spark):
    rows = corpus()
    one = M.identify(frame(spark, rows), M.fit_identifier(frame(spark, [r for r in rows if r[2] == "aa"]))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("aa", 1.0)}
    for nothing in ([], [(1, "abc", None), (2, None, "aa"), (3, "12", "bb")]):
        assert M.fit_identifier(frame(spark, nothing)) is None
    assert {r.lang_pred for r in M.identify(frame(spark, rows), None).collect()} == {"und"}
    assert M.identify(frame(spark, []), None).count() == 0


def test_fit_does_not_depend_on_layout(spark):
    rows = corpus(n=40)
    a, b = (M.fit_identifier(frame(spark, r).repartition(p), max_rows=80) for r, p in ((rows, 1), (rows[::-1], 7)))
    assert (a.axes == b.axes).all() and a.langs == b.langs


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = M.op13_language_codes(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98

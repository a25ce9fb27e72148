"""Golden rows for the scalar text rules (FIXTURES §5)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recensio.functions import text as T
from recensio.sources import pages as PG


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


CLEAN = [
    ("Valutato 4 stelle su 5 Servizio veloce! Data dell'esperienza: 3 maggio 2024", "veloce"),
    ("Ho ricevuto il pacco il 12 marzo 2024, perfetto", "ricevuto pacco perfetto"),
    ("Qualità verificata: 10/10, assistenza velocissima", "qualità assistenza velocissima"),
    ("abc123def 5 stelle", "abcdef"),
    ("Pubblicata il 7 giugno 2023 Spedizione lenta\nData dell'esperienza: 1 aprile 2023 testo perso\nrimborso negato",
     "spedizione lenta rimborso negato"),
    ("maggio 2024 consegna", "consegna"),
    ("Verifica: VERIFICATO verificate verificati", "verificati"),
    ("C'è più 15 stelle", ""),
    ("", ""),
]


@pytest.mark.parametrize("text,expected", CLEAN)
def test_clean_text(spark, text, expected):
    assert _one(spark, T.clean_text, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("5 stelle", 5), ("15 stelle", 5), ("0stella", 0), ("Valutato 3 su 5", 3),
    ("Valutato 2, 4 stelle", 4), ("stelle 4", None), (None, None),
])
def test_rating_from_text(spark, text, expected):
    assert _one(spark, T.rating_from_text, text) == expected


def test_date_text_is_case_sensitive_and_first(spark):
    assert _one(spark, T.date_text, "visto il 3 maggio 2023 e 4 giugno 2024") == "3 maggio 2023"
    assert _one(spark, T.date_text, "3 Maggio 2023") is None


def test_feature_tokens_ascii_letters_only(spark):
    df = spark.createDataFrame([(["qualità", "assistenza", "foo_bar", "abc", "ab"],)], "w array<string>")
    assert df.select(T.feature_tokens(F.col("w"))).first()[0] == ["assistenza", "abc"]


def test_theme_keywords_keep_punctuation_and_first_three(spark):
    assert _one(spark, T.theme_keywords, "Spedizione veloce, e puntuale davvero") == ["spedizione", "veloce,", "puntuale"]


@pytest.mark.parametrize("m1,m2,m3,m4,m5,expected", [
    ("/reviews/aa1", "bb", None, None, None, "aa1"),
    ("/x/", "bb", None, None, None, "bb"),
    (None, None, "/reviews/cc?x=1", None, None, "cc"),
    (None, None, "/users/1", "/reviews/dd?y#z", None, "dd"),
    (None, None, None, None, "ee", "ee"),
    (None, None, None, None, None, None),
])
def test_review_id_chain(spark, m1, m2, m3, m4, m5, expected):
    df = spark.createDataFrame([(m1, m2, m3, m4, m5)], "a string, b string, c string, d string, e string")
    got = df.select(PG.review_id_chain(*[F.col(c) for c in "abcde"])).first()[0]
    assert got == expected


def test_identity_modes(spark):
    df = spark.createDataFrame([(None, "x" * 60), ("id1", "y")], "rid string, t string")
    strict = [r[0] for r in df.select(T.identity(F.col("rid"), F.col("t"))).collect()]
    text50 = [r[0] for r in df.select(T.identity(F.col("rid"), F.col("t"), "text50")).collect()]
    assert strict == ["~null", "id1"]
    assert text50 == ["x" * 50, "id1"]

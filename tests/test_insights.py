"""Model answers: fence strip, strict JSON, first valid attempt, ordered
de-duplicated merge, keyword blacklist, sentiment (FIXTURES §5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recensio.operators import insights as IN

FENCED = ('```json\n{"punti_forza":["a","b","a"],"parole_chiave":["spedizione","Offerte Maggio"],'
          '"sentiment_counts":{"positivo":3,"neutro":1,"negativo":0}}\n```')
ROWS = [
    (0, 1, "{bad"),
    (0, 2, FENCED),
    (1, 1, '{"punti_forza":["b","c"],"sentiment_counts":{"positivo":1}}'),
    (2, 1, '{"punti_forza":["x"]} trailing'),
    (2, 2, '{"punti_forza":["x"]} trailing'),
    (2, 3, '{"punti_forza":["x"]} trailing'),
]


def _responses(spark, rows=ROWS):
    return spark.createDataFrame(rows, "block_id bigint, attempt int, content string")


def test_first_valid_attempt(spark):
    a = IN.first_valid(IN.parse_responses(_responses(spark)))
    assert sorted((r.block_id, r.attempt) for r in a.collect()) == [(0, 2), (1, 1)]


def test_merge_order_dedup_and_blacklist(spark):
    a = IN.first_valid(IN.parse_responses(_responses(spark)))
    m = IN.merge_insights(a)
    got = {}
    for r in m.orderBy("categoria", "pos").collect():
        got.setdefault(r.categoria, []).append((r.pos, r.elemento))
    assert got["punti_forza"] == [(0, "a"), (1, "b"), (2, "c")]
    assert got["parole_chiave"] == [(0, "spedizione")]
    unfiltered = IN.merge_insights(a, blacklist=False).filter(F.col("categoria") == "parole_chiave")
    assert sorted(r.elemento for r in unfiltered.collect()) == ["Offerte Maggio", "spedizione"]


def test_sentiment_sum_and_share(spark):
    a = IN.first_valid(IN.parse_responses(_responses(spark)))
    d = IN.sentiment_distribution(a).first()
    assert (d.positivo, d.neutro, d.negativo) == (4, 1, 0)
    s = IN.sentiment_share(IN.sentiment_distribution(a)).first()
    assert abs(s.positivo_pct - 80.0) < 1e-9 and abs(s.neutro_pct - 20.0) < 1e-9


def test_no_positive_means_no_share_row(spark):
    rows = [(0, 1, '{"sentiment_counts":{"positivo":0,"neutro":2}}')]
    a = IN.first_valid(IN.parse_responses(_responses(spark, rows)))
    assert IN.sentiment_share(IN.sentiment_distribution(a)).count() == 0


def test_all_answers_invalid(spark):
    rows = [(0, 1, "nope"), (0, 2, "[1,"), (1, 1, "")]
    a = IN.first_valid(IN.parse_responses(_responses(spark, rows)))
    assert a.count() == 0
    assert IN.merge_insights(a).count() == 0
    d = IN.sentiment_distribution(a).first()
    assert (d.positivo, d.neutro, d.negativo) == (0, 0, 0)


def test_attempts_beyond_limit_ignored(spark):
    rows = [(0, 1, "x"), (0, 2, "x"), (0, 3, "x"), (0, 4, '{"punti_forza":["late"]}')]
    a = IN.first_valid(IN.parse_responses(_responses(spark, rows)))
    assert a.count() == 0


def test_malformed_key_counts_as_empty(spark):
    rows = [(0, 1, '{"punti_forza": null, "punti_debolezza": ["lento"]}')]
    m = IN.merge_insights(IN.first_valid(IN.parse_responses(_responses(spark, rows))))
    assert [(r.categoria, r.elemento) for r in m.collect()] == [("punti_debolezza", "lento")]


def test_scalar_answers_ask_again(spark):
    good = '{"punti_forza":["x"]}'
    rows = [(b, 1, first) for b, first in enumerate(["123", "null", "true", "1.5", '"text"', "[1]", "{}"])] + [(b, 2, good) for b in range(7)]
    a = {r.block_id: r.attempt for r in IN.first_valid(IN.parse_responses(_responses(spark, rows))).collect()}
    assert a == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1}


def test_merge_within_each_company(spark):
    rows = [("a", 0, 1, '{"punti_forza":["x","y"]}'), ("b", 0, 1, '{"punti_forza":["y"]}'), ("b", 1, 1, '{"punti_forza":["x","y"],"sentiment_counts":{"positivo":2}}')]
    resp = spark.createDataFrame(rows, "company string, block_id bigint, attempt int, content string")
    answers = IN.first_valid(IN.parse_responses(resp))
    got = sorted((r.company, r.pos, r.elemento) for r in IN.merge_insights(answers).collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "x")]
    assert {r.company: r.positivo for r in IN.sentiment_distribution(answers).collect()} == {"a": 0, "b": 2}

"""Theme matching rules and the two exact plans."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oracle import SF_SMALL
from recensio.config import Config
from recensio.operators import themes as TH
from recensio.plans import queries as Q


def _reviews(spark, rows):
    return spark.createDataFrame(
        [(s, rid, txt, txt.split(" ") if txt else [], rating) for s, rid, txt, rating in rows],
        "seq bigint, review_id string, testo_pulito string, parole array<string>, rating int",
    ).withColumn("testo", F.col("testo_pulito")).withColumn("data", F.lit(None).cast("string")).withColumn("link", F.lit("l"))


def _themes(spark, rows):
    return spark.createDataFrame(rows, "tipo string, theme_pos int, punto string")


def test_band_identity_and_share(spark):
    r = _reviews(spark, [
        (1, None, "consegna veloce pacco", 5), (2, None, "consegna veloce", 4),
        (3, "a", "consegna lenta", 5), (4, "b", "altro", 0), (5, "c", "consegna veloce", None),
        (6, "d", "consegna lenta rotto", 1),
    ])
    th = _themes(spark, [("punti_forza", 0, "Consegna veloce"), ("punti_forza", 1, "a of"),
                         ("punti_debolezza", 0, "consegna, lenta"), ("punti_debolezza", 1, "lenta rotto")])
    f = {(x.tipo, x.theme_pos): (x["count"], x.percentuale) for x in TH.theme_frequency(r, th).collect()}
    # ids NULL count once; band rows 3 (ratings 5, 4, 5).
    assert f[("punti_forza", 0)] == (1, pytest.approx(100 / 3))
    # no keyword: every band review matches (2 identities: NULL and 'a').
    assert f[("punti_forza", 1)] == (2, pytest.approx(200 / 3))
    # 'consegna,' never matches: the theme is dropped.
    assert ("punti_debolezza", 0) not in f
    assert f[("punti_debolezza", 1)] == (1, pytest.approx(100.0))


def test_substring_not_token(spark):
    r = _reviews(spark, [(1, "a", "spedizioni rapidissime", 5)])
    th = _themes(spark, [("punti_forza", 0, "spedizione rapida")])
    assert TH.theme_frequency(r, th).count() == 0
    th2 = _themes(spark, [("punti_forza", 0, "spedizioni rapid")])
    assert TH.theme_frequency(r, th2).collect()[0]["count"] == 1


def test_examples_first_two_identities(spark):
    r = _reviews(spark, [(1, "a", "ottima qualita", 5), (2, "a", "ottima qualita", 5),
                         (3, "b", "ottima qualita", 4), (4, "c", "ottima qualita", 5)])
    th = _themes(spark, [("punti_forza", 0, "ottima qualita"), ("punti_forza", 1, "a of")])
    ex = TH.theme_examples(r, th).collect()
    assert sorted((x.theme_pos, x.seq) for x in ex) == [(0, 1), (0, 3)]


def test_word_index_plan_equals_broadcast_plan(spark):
    # one company: numbers made unique again
    reviews = Q.reviews_df(spark, SF_SMALL)
    reviews = reviews.withColumn("seq", F.col("seq") * 24 + F.substring("company", 2, 9).cast("long")).drop("company")
    words = [r[0] for r in reviews.select(F.explode("parole")).distinct().orderBy(F.col("col")).limit(400).collect()]
    rnd = random.Random(11)
    rows = []
    for tipo in ("punti_forza", "punti_debolezza"):
        for i in range(40):
            n = rnd.choice([1, 2, 3, 4])
            ws = [rnd.choice(words)[: rnd.choice([4, 5, 8, 20])] for _ in range(n)]
            rows.append((tipo, i, " ".join(ws)))
    # Repeated keywords, three keywords, partial and absent keywords.
    common = [x[0] for x in reviews.select(F.explode("parole").alias("w")).filter(F.length("w") > 3)
              .groupBy("w").count().orderBy(F.desc("count"), "w").limit(3).collect()]
    rows += [("punti_forza", 100, f"{common[0]} {common[0]}"),
             ("punti_forza", 101, f"{common[0]} {common[1]} {common[2]}"),
             ("punti_forza", 102, f"{common[0]} zzzzqq {common[1]}"),
             ("punti_debolezza", 100, f"{common[1]} {common[1]} zzzzqq"),
             ("punti_debolezza", 101, "zzzzqq {0}".format(common[2]))]
    th = _themes(spark, rows)
    a = TH.theme_frequency(reviews, th, replace(Q.CFG, theme_plan="broadcast"))
    b = TH.theme_frequency(reviews, th, replace(Q.CFG, theme_plan="index"))
    key = lambda x: (x.tipo, x.theme_pos, x["count"])
    got = sorted(map(key, a.collect()))
    assert got == sorted(map(key, b.collect()))
    assert {(t, p) for t, p, _ in got} >= {("punti_forza", 100), ("punti_forza", 101), ("punti_debolezza", 100)}
    ea = TH.theme_examples(reviews, th, replace(Q.CFG, theme_plan="broadcast"))
    eb = TH.theme_examples(reviews, th, replace(Q.CFG, theme_plan="index"))
    ekey = lambda x: (x.tipo, x.theme_pos, x.example, x.seq)
    assert sorted(map(ekey, ea.collect())) == sorted(map(ekey, eb.collect()))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_theme_examples_partition_independent(spark, parts):
    rnd = random.Random(parts)
    words = ["consegna", "veloce", "pacco", "rotto", "prezzo", "ottimo"]
    rows = [(s, f"id{rnd.randrange(15)}", " ".join(rnd.sample(words, 3)), rnd.choice([1, 2, 4, 5])) for s in range(120)]
    r = _reviews(spark, rows).repartition(parts)
    th = _themes(spark, [("punti_forza", 0, "consegna veloce"), ("punti_debolezza", 0, "pacco rotto")])
    got = sorted((x.tipo, x.example, x.seq) for x in TH.theme_examples(r, th).collect())
    expected = []
    for tipo, kws, band in (("punti_forza", ("consegna", "veloce"), (4, 5)), ("punti_debolezza", ("pacco", "rotto"), (1, 2))):
        seen, n = set(), 0
        for s, rid, txt, rating in rows:
            if rating in band and all(k in txt for k in kws) and rid not in seen and n < 2:
                seen.add(rid)
                n += 1
                expected.append((tipo, n, s))
    assert got == sorted(expected)


def test_all_ratings_null_gives_no_rows(spark):
    r = _reviews(spark, [(1, "a", "consegna veloce", None), (2, "b", "consegna veloce", 0)])
    th = _themes(spark, [("punti_forza", 0, "consegna veloce"), ("punti_forza", 1, "a of")])
    assert TH.theme_frequency(r, th).count() == 0
    assert TH.theme_examples(r, th).count() == 0


def test_all_ids_null_count_once_and_text50(spark):
    rows = [(1, None, "consegna veloce uno", 5), (2, None, "consegna veloce due", 5), (3, None, "consegna veloce uno", 4)]
    r = _reviews(spark, rows)
    th = _themes(spark, [("punti_forza", 0, "consegna veloce")])
    strict = TH.theme_frequency(r, th).first()
    assert (strict["count"], strict.percentuale) == (1, pytest.approx(100 / 3))
    loose = TH.theme_frequency(r, th, replace(Config(), identity="text50")).first()
    assert loose["count"] == 2


def test_bitmaps_with_a_keyword_in_every_review(spark):
    """Hot keywords, hot identity, sparse and dense review numbers, two
    companies: counts as computed plainly, and rows per word, not per review."""
    rnd = random.Random(4)
    words = ["consegna", "veloce", "pacco", "rotto", "prezzo", "ottimo", "lento"]
    rows = []
    for c, n, spread in (("a", 700, 1), ("b", 300, 1 << 20)):
        for s in range(n):
            txt = " ".join(["sempre", *rnd.sample(words, 3)])
            rows.append((c, s * spread, None if s % 3 == 0 else f"id{rnd.randrange(n)}", txt, txt.split(" "), rnd.choice([1, 2, 4, 5])))
    r = spark.createDataFrame(rows, "company string, seq bigint, review_id string, testo_pulito string, parole array<string>, rating int").withColumn("testo", F.col("testo_pulito"))
    puntos = ["sempre", "sempre consegna", "sempre veloce pacco", "rotto prezzo ottimo", "sempre sempre lento", "semp", "manca lento sempre", "consegna", "lento lento", "manca"]
    themes = [(c, t, i, p) for c in "ab" for t in ("punti_forza", "punti_debolezza") for i, p in enumerate(puntos)]
    th = spark.createDataFrame(themes, "company string, tipo string, theme_pos int, punto string")
    got = {(x.company, x.tipo, x.theme_pos): x["count"] for x in TH.theme_frequency(r, th).collect()}
    want = {}
    for c, t, i, p in themes:
        kw = p.split()[:3]
        ids = {rid or "~null" for cc, _, rid, txt, _, rating in rows
               if cc == c and (rating >= 4 if t == "punti_forza" else rating <= 2) and sum(k in txt for k in kw) >= min(2, len(kw))}
        if ids:
            want[(c, t, i)] = len(ids)
    assert got == want and len(want) == 36
    band, prepared = TH.band_reviews(r, Config()), TH.theme_keywords(th)
    bitmaps = TH.keyword_bitmaps(band, TH._kw_rows(prepared))
    assert bitmaps.filter("company = 'a' and kw = 'sempre'").count() <= 2 * 11
    assert TH._matched_words(bitmaps, spark.createDataFrame([("a", "punti_forza", "consegna sempre")], "company string, tipo string, kws string")).count() <= 11

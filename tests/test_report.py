"""Report sinks and display formatting."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from recensio.plans import report as RP


def test_write_report_one_directory_per_table(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(2.5,)], "p double")
    out = RP.write_report({"recensioni": a, "tematiche": b}, str(tmp_path), fmt="parquet")
    assert [o.rsplit("/", 1)[1] for o in out] == ["recensioni", "tematiche"]
    assert spark.read.parquet(out[0]).collect()[0].v == "x"
    out = RP.write_report({"recensioni": a}, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", "true").csv(out[0]).collect()[0].v == "x"


def test_report_json_lines_nan_and_nulls(spark, tmp_path):
    stats = spark.createDataFrame([("c", 3, 0, float("nan"))], "company string, n_recensioni bigint, n_con_rating bigint, rating_medio double")
    topics = spark.createDataFrame([("c", 1, 0, 3, 100.0, None, ["qualità"])],
                                   "company string, rank int, id int, n_recensioni bigint, percentuale double, rating_medio double, parole_chiave array<string>")
    ins = spark.createDataFrame([("c", "punti_forza", 0, "qualità ottima")], "company string, categoria string, pos bigint, elemento string")
    sent = spark.createDataFrame([("c", 4, 1, 0)], "company string, positivo bigint, neutro bigint, negativo bigint")
    freq = spark.createDataFrame([("c", "punti_forza", 0, "qualità ottima", 2, 66.7)],
                                 "company string, tipo string, theme_pos int, punto string, count bigint, percentuale double")
    rep = RP.report_json(stats, topics, ins, sent, freq, "https://x/{company}")
    RP.write_report_json(rep, str(tmp_path / "json"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "json")).collect()]
    by = {x["sezione"]: x for x in lines}
    assert by["metadati"]["rating_medio"] is None and by["metadati"]["n_cluster"] == 1 and by["metadati"]["url_analizzato"] == "https://x/c"
    assert by["sentiment"] == {"sezione": "sentiment", "company": "c", "positivo": 4, "neutro": 1, "negativo": 0}
    assert by["tematica"]["rating_medio"] is None and by["tematica"]["tematiche"] == ["qualità"] and by["tematica"]["rank"] == 1
    assert by["insight"]["elemento"] == "qualità ottima"
    assert by["tema"]["rank"] == 1
    raw = spark.read.text(str(tmp_path / "json")).filter(F.col("value").contains("qualità")).count()
    assert raw == 3  # not ASCII-escaped


def test_one_decimal_as_python_prints(spark):
    values = [12.25, 6.25, 4.25, 12.35, 0.05, 100.0, 0.0, None, 66.65, 2.675]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", RP.one_decimal(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [None if v is None else f"{v:.1f}" for v in values]


def test_empty_channel_and_fallback(spark):
    ins = spark.createDataFrame([("a", "suggerimenti_seo", 0, "x"), ("a", "punti_debolezza", 0, "lento"), ("b", "suggerimenti_adv", 0, "y")],
                                "company string, categoria string, pos bigint, elemento string")
    ch = {(r.company, r.canale): (r.pos, r.suggerimento) for r in RP.report_channels(ins).collect()}
    assert len(ch) == 10 and ch[("a", "SEO")] == (0, "x") and ch[("b", "SEO")] == (None, "")
    freq = spark.createDataFrame([("a", "punti_forza", 0, "bello", 2, 50.0)],
                                 "company string, tipo string, theme_pos int, punto string, count bigint, percentuale double")
    rows = sorted(tuple(r) for r in RP.themes_with_fallback(freq, ins).collect())
    assert rows == [("a", "punti_debolezza", 1, "lento", "elenco"), ("a", "punti_forza", 1, "bello", "frequenza")]


def test_analyze_two_companies_from_pages(spark, tmp_path):
    from recensio.config import Config
    from recensio.operators import blocks as BL
    from recensio.operators import reviews as RV
    from recensio.sources import pages as PG

    def page(company, n, words):
        arts = "".join(f'<article data-service-review-rating="{1 + (i + n) % 5}" data-service-review-id="{company}{n}{i}"><p>{words} '
                       f'esperienza numero raccontata nel dettaglio dal cliente soddisfatto {"corriere puntuale" if i % 2 else "telefono cortese"}</p></article>' for i in range(6))
        return (company, n, f"https://x/review/{company}?page={n}", 200, f"<html>{arts}</html>")

    pages = spark.createDataFrame([page(c, n, w) for c, w in (("a", "spedizione pacco"), ("b", "assistenza rimborso")) for n in (1, 2)],
                                  "company string, pagina int, url string, status int, html string")
    cfg = Config(n_init=2, kmeans_max_iter=20, max_df=0.9, block_words=60)
    reviews = RV.to_reviews(PG.raw_from_pages(pages, cfg), cfg)
    assert reviews.count() == 24 and reviews.select("seq").distinct().count() == 12  # seq counts within a company
    blocks = BL.text_blocks(reviews, cfg)
    answers = blocks.select("company", "block_id", F.lit(1).alias("attempt"), F.lit(
        '{"punti_forza":["cliente soddisfatto","corriere puntuale"],"leve_marketing":["cura"],"sentiment_counts":{"positivo":1}}').alias("content"))
    out = RP.analyze(reviews, answers, cfg, 2, "https://x/review/{company}")  # both at once
    RP.write_report({k: out[k] for k in RP.SHEETS}, str(tmp_path))
    sheet = {k: spark.read.parquet(f"{tmp_path}/{k}").collect() for k in RP.SHEETS}
    heads = {r.company: r for r in out["headline"].collect()}
    lines = [json.loads(r.json) for r in out["json"].collect()]
    positive = {r.company: r["count"] for r in reviews.filter("rating >= 4").groupBy("company").count().collect()}
    own = {"a": {"spedizione", "pacco"}, "b": {"assistenza", "rimborso"}}
    for c in ("a", "b"):
        of = {k: [r for r in rows if r.company == c] for k, rows in sheet.items()}
        assert len(of["recensioni"]) == 12 and all(r.cluster != "" for r in of["recensioni"])
        assert sum(r.n_recensioni for r in of["tematiche"]) == 12 and sorted(r["rank"] for r in of["tematiche"]) == [1, 2]
        assert not own["b" if c == "a" else "a"] & {w for r in of["tematiche"] for w in r.tematica.split(", ")}
        assert {r.punto: r["count"] for r in of["punti_forza"]}["cliente soddisfatto"] == positive[c]
        assert (heads[c].n_recensioni, heads[c].n_punti_forza, heads[c].n_cluster) == (12, 2, 2)
        assert len(of["canali"]) == 5
        assert {x["sezione"] for x in lines if x["company"] == c} == {"metadati", "sentiment", "tematica", "insight", "tema"}


def test_analyze_too_few_reviews_for_topics(spark):
    rows = [("c", s, 1, s, f"id{s}", "testo originale", "consegna veloce", ["consegna", "veloce"], 5, None, "l") for s in range(3)]
    reviews = spark.createDataFrame(rows, "company string, seq bigint, pagina int, pos int, review_id string, testo string, testo_pulito string, "
                                          "parole array<string>, rating int, data string, link string")
    answers = spark.createDataFrame([("c", 0, 1, '{"punti_forza":["consegna veloce"],"punti_debolezza":["prezzo alto"]}')],
                                    "company string, block_id bigint, attempt int, content string")
    out = RP.analyze(reviews, answers)
    assert [r.cluster for r in out["recensioni"].collect()] == ["", "", ""]
    assert out["tematiche"].count() == 0 and out["headline"].first().n_cluster == 0
    assert [(r.punto, r["count"]) for r in out["punti_forza"].collect()] == [("consegna veloce", 3)]
    assert sorted((r.tipo, r.source) for r in out["temi"].collect()) == [("punti_debolezza", "elenco"), ("punti_forza", "frequenza")]
    assert out["canali"].count() == 5 and out["json"].count() > 3


def test_example_card_stars_and_cut(spark):
    ex = spark.createDataFrame(
        [("punti_forza", 0, "p", 1, None, "a" * 201, None, "l"), ("punti_debolezza", 0, "p", 1, 2, "b" * 200, None, "l")],
        "tipo string, theme_pos int, punto string, example int, rating int, testo string, data string, link string")
    rows = {r.tipo: r for r in RP.example_cards(ex).collect()}
    assert rows["punti_forza"].stelle == "⭐" * 3 and rows["punti_forza"].testo_breve == "a" * 200 + "..."
    assert rows["punti_debolezza"].stelle == "⭐" * 2 and rows["punti_debolezza"].testo_breve == "b" * 200
    assert rows["punti_forza"].classe == "positive-review"

"""Report tables: headline numbers, the six sheets, top-N lists, example
cards and the JSON report, plus the sink that writes them.

All inputs are the outputs of the operators (reviews, topics, merged
insights, theme frequencies); every list here is already bounded by a
top-N, so only ``report_reviews`` grows with the corpus.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recensio.config import CHANNELS, SENTIMENT_CLASSES, Config
from recensio.operators import insights as IN
from recensio.operators import themes as TH
from recensio.operators import topics as TP
from recensio.operators.reviews import company_of, review_key
from recensio.session import materialize, stored


def _truthy(c):
    return c.isNotNull() & (c != 0)


def corpus_stats(reviews: DataFrame) -> DataFrame:
    """One row per company: reviews, reviews with a (non-zero) rating, mean
    rating."""
    r = F.col("rating")
    return reviews.groupBy(*company_of(reviews)).agg(
        F.count(F.lit(1)).alias("n_recensioni"),
        F.count(F.when(_truthy(r), 1)).alias("n_con_rating"),
        F.avg(F.when(_truthy(r), r)).alias("rating_medio"),
    )


def headline(reviews: DataFrame, insights: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per company: reviews, mean rating, strengths, weaknesses,
    topics.  The inputs are stacked and counted in one aggregate (no join)."""
    by, r = company_of(reviews), F.col("rating")
    rows = reviews.select(*by, F.lit(1).alias("_review"), "rating").unionByName(
        insights.select(*by, "categoria"), allowMissingColumns=True).unionByName(
        topics.select(*by, F.lit(1).alias("_topic")), allowMissingColumns=True)
    return rows.groupBy(*by).agg(
        F.count("_review").alias("n_recensioni"),
        F.avg(F.when(_truthy(r), r)).alias("rating_medio"),
        F.count(F.when(F.col("categoria") == "punti_forza", 1)).alias("n_punti_forza"),
        F.count(F.when(F.col("categoria") == "punti_debolezza", 1)).alias("n_punti_debolezza"),
        F.count("_topic").alias("n_cluster"))


def report_reviews(labelled: DataFrame) -> DataFrame:
    """Reviews sheet: text, rating, date, topic ('' when none), link."""
    cluster = F.coalesce(F.col("cluster").cast("string"), F.lit("")) if "cluster" in labelled.columns else F.lit("")
    return labelled.select(*review_key(labelled), "testo", "rating", "data", cluster.alias("cluster"), "link")


def _one_decimal(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or x != x else f"{x:.1f}").astype(object)


@functools.cache
def _one_decimal_udf():
    return F.pandas_udf(_one_decimal, "string")


def one_decimal(c):
    """A number as text with one decimal, rounded on its exact binary value
    (halves to even).  The JVM's formatter rounds the shortest decimal form
    instead (6.25 to 6.3), so this runs in Python, on report rows only."""
    return _one_decimal_udf()(c)


def report_topics(topics: DataFrame) -> DataFrame:
    """Topics sheet from ``topics.topic_rows``: rank, id, keywords joined by
    ', ', size, share and mean as numbers and as one-decimal text ('N/A' for
    no mean)."""
    return topics.select(
        *company_of(topics), "rank", "id",
        F.array_join("parole_chiave", ", ").alias("tematica"),
        "n_recensioni",
        "percentuale",
        "rating_medio",
        F.concat(one_decimal(F.col("percentuale")), F.lit("%")).alias("percentuale_txt"),
        F.coalesce(one_decimal(F.col("rating_medio")), F.lit("N/A")).alias("rating_medio_txt"),
    )


def top_topics(topics: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The on-screen preview: the first topics by rank."""
    return topics.filter(F.col("rank") <= cfg.top_n["topics"])


def _theme_rows(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        *company_of(ranked), "tipo", F.col("rank").cast("int").alias("rank"), "punto", "count", "percentuale",
        F.concat(one_decimal(F.col("percentuale")), F.lit("%")).alias("percentuale_txt"),
    )


def report_themes(freq: DataFrame) -> DataFrame:
    """Strengths and weaknesses sheets (column ``tipo`` tells which), every
    theme with its rank (distributed ranking, ``order_themes``)."""
    return _theme_rows(TH.order_themes(freq))


def report_top_themes(freq: DataFrame, n: int) -> DataFrame:
    """The same rows for the first ``n`` themes of each type only."""
    return _theme_rows(TH.top_themes(freq, n))


def _joined(insights: DataFrame, categoria: str, limit: int) -> DataFrame:
    by = company_of(insights)
    it = insights.filter((F.col("categoria") == categoria) & (F.col("pos") < limit))
    # At most ``limit`` items; a company without any has an empty list.
    it = it.unionByName(insights.select(*by).distinct(), allowMissingColumns=True)
    return it.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "elemento")))), lambda x: x["elemento"]), " | ").alias("insights"))


def report_general(insights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """General sheet per company: first 10 levers and first 20 keywords,
    ' | '-joined ('' for none)."""
    by = company_of(insights)
    lev = _joined(insights, "leve_marketing", 10).select(*by, F.lit("Leve Marketing").alias("categoria"), "insights")
    kw = _joined(insights, "parole_chiave", 20).select(*by, F.lit("Parole Chiave").alias("categoria"), "insights")
    return lev.unionByName(kw).select(*by, "categoria", F.coalesce("insights", F.lit("")).alias("insights"))


def report_channels(insights: DataFrame) -> DataFrame:
    """Channel sheet in long form: (company, ord, canale, pos, suggerimento),
    every item of each channel in merge order; a company's channel without
    items has one row with pos NULL and ''.  The lists grow with the corpus, so they are
    not folded into one string per channel (that would put a whole channel
    in one task); a reader joins ``suggerimento`` by ' | ' in ``pos`` order."""
    by = company_of(insights)
    chans = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lab).alias("canale"), F.lit(cat).alias("categoria")) for i, (lab, cat) in enumerate(CHANNELS)])
    companies = insights.select(*by).distinct() if by else insights.sparkSession.range(1).select()
    # Each company's five channels, with its items where there are any.
    rows = companies.select(*by, F.explode(chans).alias("c")).select(*by, "c.*")
    return rows.join(insights, [*by, "categoria"], "left").select(*by, "ord", "canale", "pos", F.coalesce("elemento", F.lit("")).alias("suggerimento"))


def top_insights(insights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The on-screen lists: first N of each category (N per category)."""
    lim = F.create_map(*[x for k, v in cfg.top_n.items() if k != "topics" for x in (F.lit(k), F.lit(v))])
    return insights.filter(F.col("pos") < F.coalesce(F.try_element_at(lim, F.col("categoria")), F.lit(0))).select(
        *company_of(insights), "categoria", "pos", "elemento"
    )


def themes_with_fallback(freq: DataFrame, insights: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Ranked themes per type (first 10); a type without any frequency
    shows its first 10 raw themes instead, ``source`` tells which."""
    by, n = company_of(freq), cfg.top_n["punti_forza"]
    # Written (at most n rows per type): the frequencies are made once, and a
    # type with any has a first one.
    top = materialize(TH.top_themes(freq, max(n, 1)).select(*by, "tipo", F.col("rank").cast("int").alias("rank"), "punto"))
    ranked = top.filter(F.col("rank") <= n).withColumn("source", F.lit("frequenza"))
    present = top.filter("rank = 1").select(*by, "tipo")
    raw = (
        insights.filter(F.col("categoria").isin("punti_forza", "punti_debolezza") & (F.col("pos") < 10))
        .select(*by, F.col("categoria").alias("tipo"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("elemento").alias("punto"))
        .join(present, [*by, "tipo"], "left_anti")
        .withColumn("source", F.lit("elenco"))
    )
    return ranked.unionByName(raw)


def example_cards(examples: DataFrame, tipo_col: str = "tipo", width: int = 200) -> DataFrame:
    """Display form of theme examples: stars (3 when no rating), text cut
    at ``width`` chars with '...', date, link, class by type."""
    stars = F.repeat(F.lit("⭐"), F.when(_truthy(F.col("rating")), F.col("rating")).otherwise(F.lit(3)))
    text = F.when(F.length("testo") > width, F.concat(F.substring("testo", 1, width), F.lit("..."))).otherwise(F.col("testo"))
    klass = F.when(F.col(tipo_col) == "punti_forza", F.lit("positive-review")).otherwise(F.lit("negative-review"))
    return examples.select(
        *company_of(examples), "tipo", "theme_pos", "punto", "example", stars.alias("stelle"), text.alias("testo_breve"), "data", "link", klass.alias("classe"))


def topic_cards(topics: DataFrame, per_card: int = 2, width: int = 150) -> DataFrame:
    """One row per (topic, example <= 2) of ``topics.topic_rows``, with the
    topic's rank: title, first 3 keywords, share, stars and text cut at
    ``width``."""
    ex = topics.select(
        *company_of(topics), "rank", "id", (F.col("id") + 1).alias("titolo"), F.array_join(F.slice("parole_chiave", 1, 3), ", ").alias("tematiche"),
        "percentuale", F.explode_outer(F.filter("esempi", lambda e: e["example"] <= per_card)).alias("e"))
    rating, testo = F.col("e.rating"), F.col("e.testo")
    stars = F.when(F.col("e").isNotNull(), F.repeat(F.lit("⭐"), F.when(_truthy(rating), rating).otherwise(F.lit(3))))
    text = F.when(F.length(testo) > width, F.concat(F.substring(testo, 1, width), F.lit("..."))).otherwise(testo)
    return ex.select(*company_of(topics), "rank", "id", "titolo", "tematiche", "percentuale", "e.example", stars.alias("stelle"), text.alias("testo_breve"), "e.link")


# --- one analysis ---

def analyze(reviews: DataFrame, responses: DataFrame, cfg: Config = Config(), n_topics: int | None = None, url: str | None = None) -> dict[str, DataFrame]:
    """The whole analysis of every company of a table: the reviews (the
    ``reviews`` table, from pages or ready-made) and the model's answers to
    their blocks, to the six report tables, the headline, the lists and cards, and the JSON lines.

    Reviews, topics, merged insights and frequencies are written once each and
    read from there, so the text is cleaned once and labelled once.
    """
    reviews = stored(reviews)
    labelled, centroids, vocab, k = TP.assign_topics(reviews, n_topics, cfg, written=True)
    labelled = stored(labelled)
    if k:
        topics = materialize(TP.topic_rows(labelled, centroids, vocab, k, cfg))
    else:  # too few reviews or no vocabulary: no topics
        rows = TP.topic_rows(labelled.withColumn("cluster", F.lit(0)), reviews.sparkSession.createDataFrame([(0, [0.0])], "cluster int, weights array<double>"), [("-", 1.0)], 1, cfg)
        topics = materialize(rows.filter(F.lit(False)))
    answers = materialize(IN.first_valid(IN.parse_responses(responses), cfg))
    insights = materialize(IN.merge_insights(answers, cfg))
    themes = insights.filter(F.col("categoria").isin(TH.STRENGTHS, TH.WEAKNESSES)).select(
        *company_of(insights), F.col("categoria").alias("tipo"), F.col("pos").cast("int").alias("theme_pos"), F.col("elemento").alias("punto"))
    freq = materialize(TH.theme_frequency(labelled, themes, cfg, written=True))
    stats, sentiment = corpus_stats(labelled), IN.sentiment_distribution(answers)
    return {
        "recensioni": report_reviews(labelled),
        "tematiche": report_topics(topics),
        "punti_forza": report_themes(freq).filter(F.col("tipo") == TH.STRENGTHS),
        "punti_debolezza": report_themes(freq).filter(F.col("tipo") == TH.WEAKNESSES),
        "analisi_generale": report_general(insights, cfg),
        "canali": report_channels(insights),
        "headline": headline(labelled, insights, topics),
        "sentiment": sentiment,
        "anteprima_tematiche": top_topics(topics, cfg),
        "schede_tematiche": topic_cards(topics),
        "liste": top_insights(insights, cfg),
        "temi": themes_with_fallback(freq, insights, cfg),
        "esempi": example_cards(TH.theme_examples(labelled, themes, cfg)),
        "json": report_json(stats, topics, insights, sentiment, freq, url),
    }


SHEETS = ("recensioni", "tematiche", "punti_forza", "punti_debolezza", "analisi_generale", "canali")


# --- sinks ---------------------------------------------------------------------

def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """The multi-sheet export: each table is written by the executors to
    ``<path>/<name>`` (one directory per sheet, nothing goes through the
    driver).  Returns the directories written."""
    out = []
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w = w.option("header", "true")
        w.format(fmt).save(target)
        out.append(target)
    return out


def _entries(df: DataFrame, section: str, key_order: list[str]) -> DataFrame:
    """One JSON object per row, tagged with its section; NULL fields are
    written as null, NaN is turned into null first."""
    cols = []
    for c in [*company_of(df), *key_order]:
        dt = dict(df.dtypes)[c]
        v = F.col(c)
        if dt in ("double", "float"):
            v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        cols.append(v.alias(c))
    body = F.struct(F.lit(section).alias("sezione"), *cols)
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def report_json(stats: DataFrame, topics: DataFrame, insights: DataFrame, sentiment: DataFrame,
                freq: DataFrame, url: str | None = None, n_themes: int = 20) -> DataFrame:
    """The JSON report as JSON Lines, one object per entry, keys ``company``
    and ``sezione``: ``metadati`` (review count, mean rating, topics, analysed
    URL), ``sentiment`` (summed counts), ``tematica`` (one per topic: rank,
    id, keywords, size, share, mean), ``insight`` (categoria, pos, elemento)
    and ``tema`` (first ``n_themes`` per type, no examples).  Merged insights
    grow with the corpus, so the report is a distributed set of lines rather
    than one document built in one task.  In ``url``, ``{company}`` stands
    for the company."""
    by = company_of(stats)
    # The stats row and the topic rows of a company, stacked and folded.
    meta = stats.unionByName(topics.select(*by, F.lit(1).alias("_topic")), allowMissingColumns=True).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n_recensioni", "n_con_rating", "rating_medio")],
        F.count("_topic").alias("n_cluster"))
    at = F.lit(url).cast("string")
    meta = meta.withColumn("url_analizzato", F.replace(at, F.lit("{company}"), F.col("company")) if by else at)
    shown = topics.withColumnRenamed("parole_chiave", "tematiche")
    themes = report_top_themes(freq, n_themes)
    parts = [
        _entries(meta, "metadati", ["n_recensioni", "n_con_rating", "rating_medio", "n_cluster", "url_analizzato"]),
        _entries(sentiment, "sentiment", list(SENTIMENT_CLASSES)),
        _entries(shown, "tematica", ["rank", "id", "tematiche", "n_recensioni", "percentuale", "rating_medio"]),
        _entries(insights, "insight", ["categoria", "pos", "elemento"]),
        _entries(themes, "tema", ["tipo", "rank", "punto", "count", "percentuale"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the JSON Lines report as text files (UTF-8, not ASCII-escaped)."""
    report.write.mode(mode).text(path)

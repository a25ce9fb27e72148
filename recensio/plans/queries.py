"""The registered queries: name -> (Spark callable, DuckDB oracle SQL).

Each Spark callable takes (spark, sf_dir) and returns a DataFrame built from
the driver tables; the SQL computes the same rows in DuckDB over the same
parquet files.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators import reviews as RV
from recensio.operators import themes as TH
from recensio.plans import sql_text as S
from recensio.session import ensure_checkpoint_dir, materialize, ship_package, stored
from recensio.sources import tables as SRC

CFG = Config()
# The fixed themes are a literal table: matched by broadcast.
LITERAL_THEMES = replace(CFG, theme_plan="broadcast")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def reviews_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RV.to_reviews(SRC.raw_reviews_from_documents(spark, sf_dir), CFG)


def stored_reviews(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of the reviews (all, if none are named), written once so the
    text is cleaned once.  The cleaned text is its words with spaces between."""
    r = reviews_df(spark, sf_dir)
    cols = cols or tuple(r.columns)
    kept = stored(r.select(*[c for c in cols if c != "testo_pulito"]))
    return kept.select(*[F.array_join("parole", " ").alias(c) if c == "testo_pulito" else c for c in cols])


def chain_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns the whole-chain queries read several times (blocks, theme
    match, band sizes)."""
    return stored_reviews(spark, sf_dir, "company", "seq", "review_id", "testo_pulito", "parole", "rating", *(["testo"] if CFG.identity == "text50" else []))


def r6(c):
    return F.round(c, 6)


# --- theme frequency -----------------------------------------------------------

THEME_CTES = dict(
    themes=S.THEMES,
    th=f"select *, len(kw) as nkw from (select *, {S.theme_keywords_sql('punto')} as kw from themes)",
    band=f"""select company, seq, coalesce(review_id, '~null') as ident, {S.BAND} as tipo, lower(testo_pulito) as txt
             from reviews where ({S.BAND}) is not null""",
    matches="""select th.company, th.tipo, th.theme_pos, th.punto, th.nkw, band.seq, band.ident
               from band join th on band.company = th.company and band.tipo = th.tipo
               and len(list_filter(th.kw, lambda k: contains(band.txt, k))) >= least(2, th.nkw)""",
    sizes="select company, tipo, count(*) as band_rows from band group by all",
)


@register("theme_frequency", S.with_ctes(
    """select c.company, c.tipo, c.theme_pos, c.punto, c."count", round(c."count" / s.band_rows * 100, 6) as percentuale
       from (select company, tipo, theme_pos, punto, count(distinct ident) as "count" from matches group by all) c
       join sizes s on c.company = s.company and c.tipo = s.tipo""", **THEME_CTES))
def q_theme_frequency(spark, sf_dir):
    f = TH.theme_frequency(reviews_df(spark, sf_dir), SRC.fixed_themes(spark), LITERAL_THEMES)
    return f.withColumn("percentuale", r6("percentuale"))


@register("theme_examples", S.with_ctes(
    """select p.company, p.tipo, p.theme_pos, p.punto, cast(p.example as integer) as example, p.seq, r.review_id, r.testo, r.rating, r.data, r.link
       from (select *, row_number() over (partition by company, tipo, theme_pos, punto order by seq) as example
             from (select company, tipo, theme_pos, punto, ident, min(seq) as seq from matches where nkw > 0 group by all)) p
       join reviews r on p.company = r.company and p.seq = r.seq
       where p.example <= 2""", **THEME_CTES))
def q_theme_examples(spark, sf_dir):
    return TH.theme_examples(reviews_df(spark, sf_dir), SRC.fixed_themes(spark), LITERAL_THEMES)


# --- text and review table -------------------------------------------------------

from recensio.functions import text as T  # noqa: E402


@register("clean_text", S.with_ctes("select seq, testo_pulito from reviews"))
def q_clean_text(spark, sf_dir):
    return reviews_df(spark, sf_dir).select("seq", "testo_pulito")


@register("rating_from_text", S.with_ctes(f"select seq, {S.rating_from_text_sql('testo')} as rating_text from raw_reviews"))
def q_rating_from_text(spark, sf_dir):
    raw = SRC.raw_reviews_from_documents(spark, sf_dir)
    return raw.select("seq", T.rating_from_text(F.col("testo")).alias("rating_text"))


@register("review_date_text", S.with_ctes("select seq, data from reviews"))
def q_review_date_text(spark, sf_dir):
    return reviews_df(spark, sf_dir).select("seq", "data")


@register("review_link", S.with_ctes("select seq, review_id, link from reviews"))
def q_review_link(spark, sf_dir):
    return reviews_df(spark, sf_dir).select("seq", "review_id", "link")


@register("min_length", S.with_ctes("select seq, cast(length(testo) as integer) as n_chars from raw_reviews where length(testo) >= 50"))
def q_min_length(spark, sf_dir):
    raw = RV.min_length(SRC.raw_reviews_from_documents(spark, sf_dir), CFG)
    return raw.select("seq", F.length("testo").alias("n_chars"))


@register("reviews_table", S.with_ctes(
    "select company, seq, pagina, pos, review_id, testo, testo_pulito, rating, data, link from reviews"))
def q_reviews_table(spark, sf_dir):
    return reviews_df(spark, sf_dir).drop("parole")


VARIANT_RAW = """
select company, seq, pagina, pos, page_url, review_id,
       case when seq % 11 = 0 then 'five' when seq % 11 in (1, 2) then '' when seq % 11 = 3 then null
            else rating_attr end as rating_attr,
       case when seq % 11 = 1 then '4' when seq % 11 = 2 then '' when seq % 11 = 3 then 'x' end as rating_div,
       testo
from raw_docs
"""


def variant_raw(spark, sf_dir):
    """Raw records with container / nested rating attributes of every kind."""
    raw = SRC.raw_reviews_from_documents(spark, sf_dir)
    m = F.col("seq") % 11
    return raw.withColumn(
        "rating_attr",
        F.when(m == 0, F.lit("five")).when(m.isin(1, 2), F.lit("")).when(m == 3, F.lit(None)).otherwise(F.col("rating_attr")),
    ).withColumn(
        "rating_div",
        F.when(m == 1, F.lit("4")).when(m == 2, F.lit("")).when(m == 3, F.lit("x")),
    )


@register("rating_resolve", S.with_ctes("select seq, rating from reviews", raw=VARIANT_RAW))
def q_rating_resolve(spark, sf_dir):
    return RV.to_reviews(variant_raw(spark, sf_dir), CFG).select("seq", "rating")


@register("rejected_rows", S.with_ctes("""
select seq, case when coalesce(rating_attr, '') <> '' then 'rating attribute is not an integer'
                 else 'nested rating attribute is not an integer' end as reason
from raw_reviews
where length(testo) >= 50
  and ((coalesce(rating_attr, '') <> '' and try_cast(rating_attr as integer) is null)
       or (coalesce(rating_attr, '') = '' and rating_div is not null and try_cast(rating_div as integer) is null))
""", raw=VARIANT_RAW))
def q_rejected_rows(spark, sf_dir):
    return RV.rejected(variant_raw(spark, sf_dir), CFG).select("seq", "reason")


@register("corpus_stats", S.with_ctes("""
select company, count(*) as n_recensioni,
       count(*) filter (where rating is not null and rating <> 0) as n_con_rating,
       round(avg(rating) filter (where rating <> 0), 6) as rating_medio
from reviews group by company"""))
def q_corpus_stats(spark, sf_dir):
    from recensio.plans import report as RP
    return RP.corpus_stats(reviews_df(spark, sf_dir)).withColumn("rating_medio", r6("rating_medio"))


@register("rating_band", S.with_ctes(f"select seq, {S.BAND} as tipo from reviews where ({S.BAND}) is not null"))
def q_rating_band(spark, sf_dir):
    r = reviews_df(spark, sf_dir)
    return r.select("seq", TH.rating_band(F.col("rating"), CFG).alias("tipo")).filter(F.col("tipo").isNotNull())


@register("theme_match", S.with_ctes("select company, tipo, theme_pos, seq from matches", **THEME_CTES))
def q_theme_match(spark, sf_dir):
    m = TH.theme_matches(reviews_df(spark, sf_dir), SRC.fixed_themes(spark), LITERAL_THEMES)
    return m.select("company", "tipo", "theme_pos", "seq")


@register("theme_frequency_word_index", ORACLE["theme_frequency"])
def q_theme_frequency_word_index(spark, sf_dir):
    """Same result through the word-index plan, the one for themes from data."""
    f = TH.theme_frequency(chain_reviews(spark, sf_dir), SRC.fixed_themes(spark), CFG, written=True)
    return f.withColumn("percentuale", r6("percentuale"))


# --- features and topics ---------------------------------------------------------

from pyspark.sql import Window  # noqa: E402

from recensio.operators import features as FT  # noqa: E402
from recensio.operators import kmeans as KM  # noqa: E402
from recensio.operators import topics as TP  # noqa: E402

FEATURE_CTES = dict(
    toks="""select company, seq, unnest(list_filter(parole, lambda w: regexp_full_match(w, '[a-zA-Z]{3,}'))) as term from reviews""",
    tf="select company, seq, term, count(*) as tf from toks group by all",
    nd="select count(*) as n from reviews",
    stats="select term, count(*) as df, sum(tf) as cf from tf group by term",
    vocab="""select cast(row_number() over (order by term) - 1 as integer) as idx, term, df, cf,
                    ln((1.0 + nd.n) / (df + 1.0)) + 1.0 as idf
             from (select * from stats, nd where df >= 2 and df <= 0.8 * nd.n order by cf desc, term limit 100), nd""",
    w="select tf.company, tf.seq, v.idx, v.term, tf.tf * v.idf as w from tf join vocab v on tf.term = v.term",
    tfidf="select company, seq, idx, term, w / sqrt(sum(w * w) over (partition by company, seq)) as tfidf from w",
)


def vocab_df(spark, sf_dir):
    r = reviews_df(spark, sf_dir)
    return r, FT.vocabulary(r, CFG)


@register("feature_tokens", S.with_ctes(
    "select seq, list_filter(parole, lambda w: regexp_full_match(w, '[a-zA-Z]{3,}')) as tokens from reviews"))
def q_feature_tokens(spark, sf_dir):
    return reviews_df(spark, sf_dir).select("seq", T.feature_tokens(F.col("parole")).alias("tokens"))


@register("vocabulary", S.with_ctes("select idx, term, df, cast(cf as bigint) as cf, round(idf, 6) as idf from vocab", **FEATURE_CTES))
def q_vocabulary(spark, sf_dir):
    _, v = vocab_df(spark, sf_dir)
    return v.withColumn("idf", r6("idf"))


@register("tfidf", S.with_ctes("select company, seq, idx, term, round(tfidf, 6) as tfidf from tfidf", **FEATURE_CTES))
def q_tfidf(spark, sf_dir):
    return FT.tfidf(reviews_df(spark, sf_dir), CFG).withColumn("tfidf", r6("tfidf"))


@register("auto_k", S.with_ctes(
    "select count(*) as n_recensioni, cast(least(8, greatest(3, count(*) // 10)) as integer) as k from reviews"))
def q_auto_k(spark, sf_dir):
    r = reviews_df(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("n_recensioni")).select("n_recensioni", TP.auto_k(F.col("n_recensioni")).alias("k"))


@register("topics_guard", S.with_ctes(
    "select nd.n as n_recensioni, (select count(*) from vocab) as n_terms, nd.n >= 5 and (select count(*) from vocab) > 0 as clusters from nd",
    **FEATURE_CTES))
def q_topics_guard(spark, sf_dir):
    r, v = vocab_df(spark, sf_dir)
    rows = r.select(F.lit(1).alias("_review")).unionByName(v.select(F.lit(1).alias("_term")), allowMissingColumns=True)
    return rows.agg(F.count("_review").alias("n_recensioni"), F.count("_term").alias("n_terms")).select(
        "n_recensioni", "n_terms", ((F.col("n_recensioni") >= 5) & (F.col("n_terms") > 0)).alias("clusters"))


COMPANY_CTES = dict(
    mine="select * from reviews",
    sizes_c="select company, count(*) as n from mine group by company",
    toks_c="""select company, seq, unnest(list_filter(parole, lambda w: regexp_full_match(w, '[a-zA-Z]{3,}'))) as term from mine""",
    tf_c="select company, seq, term, count(*) as tf from toks_c group by all",
    stats_c="select company, term, count(*) as df, sum(tf) as cf from tf_c group by all",
    vocab_c="""select company, n, cast(row_number() over (partition by company order by term) - 1 as integer) as idx, term, df, cf,
                      ln((1.0 + n) / (df + 1.0)) + 1.0 as idf
               from (select *, row_number() over (partition by company order by cf desc, term) as nth
                     from stats_c join sizes_c using (company) where df >= 2 and df <= 0.8 * n)
               where nth <= 100""",
    w_c="select t.company, t.seq, v.idx, v.term, t.tf * v.idf as w from tf_c t join vocab_c v on t.company = v.company and t.term = v.term",
    tfidf_c="select company, seq, idx, term, w / sqrt(sum(w * w) over (partition by company, seq)) as tfidf from w_c",
)


@register("company_vocabulary", S.with_ctes(
    "select company, idx, term, df, cast(cf as bigint) as cf, round(idf, 6) as idf from vocab_c", **COMPANY_CTES))
def q_company_vocabulary(spark, sf_dir):
    """Each company's own vocabulary."""
    dicts = FT.dictionaries(reviews_df(spark, sf_dir), CFG)
    return FT.company_vocabulary(dicts).withColumn("idf", r6("idf"))


@register("company_tfidf", S.with_ctes(
    "select company, seq, idx, term, round(tfidf, 6) as tfidf from tfidf_c", **COMPANY_CTES))
def q_company_tfidf(spark, sf_dir):
    """Weights over each company's own vocabulary."""
    words, dicts = company_words(spark, sf_dir)
    return FT.company_tfidf(FT.company_vectors(words, dicts)).withColumn("tfidf", r6("tfidf"))


def company_words(spark, sf_dir):
    """(words, dictionaries); the text is cleaned once."""
    words = stored(reviews_df(spark, sf_dir).select("company", "seq", "parole"))
    return words, materialize(FT.dictionaries(words, CFG))


@register("topic_labels")
def q_topic_labels(spark, sf_dir):
    """k-means labels of every company's reviews (SQL for its parts:
    topic_seeds, topic_lloyd, topic_lloyd_labels)."""
    labelled, _, _, _ = TP.assign_topics(reviews_df(spark, sf_dir), None, CFG)
    return labelled.select("company", "seq", "cluster")


# Turns, steps and starts that the SQL below spells out.
SEED_TURNS, LLOYD_STEPS = 8, 3


def _kmeans_ctes() -> dict[str, str]:
    m = KM.PRIME
    mult = ", ".join(f"({s}, {t}, {KM.multiplier(CFG.kmeans_seed, s, t)})" for s in range(CFG.n_init) for t in range(SEED_TURNS))
    ctes = dict(
        COMPANY_CTES,
        able="select company, n, cast(least(8, greatest(3, n // 10)) as integer) as k from sizes_c where n >= 5 and company in (select company from vocab_c)",
        xv="select company, seq, idx, cast(floor(tfidf * 1000000 + 0.5) as bigint) as x from tfidf_c",
        pts=f"""select m.company, m.seq, a.k, coalesce(q.xx, 0) as xx,
                       ('0x' || substr(md5(m.company || '/' || cast(m.seq as varchar)), 1, 8))::bigint % {m} as draw
                from mine m join able a on m.company = a.company
                left join (select company, seq, sum(x * x)::bigint as xx from xv group by all) q on m.company = q.company and m.seq = q.seq""",
        mult=f"select * from (values {mult}) t(start, turn, a)",
        times=f"""select p.company, p.seq, p.k, t.start, t.turn, -ln((((x2 * a + 1) % {m}) + 1) / ({m} + 1.0)) as time
                  from (select company, seq, start, turn, a, (x1 * x1 + draw) % {m} as x2
                        from (select company, seq, draw, start, turn, a, draw * a % {m} as x1 from pts, mult)) t
                  join pts p on p.company = t.company and p.seq = t.seq""",
        pairs="""select a.company, a.seq as a, b.seq as b, a.xx + b.xx - 2 * coalesce(g.dot, 0) as d
                 from pts a join pts b on a.company = b.company
                 left join (select x.company, x.seq as a, y.seq as b, sum(x.x * y.x)::bigint as dot
                            from xv x join xv y on x.company = y.company and x.idx = y.idx group by all) g
                 on g.company = a.company and g.a = a.seq and g.b = b.seq""",
        seeds0="""select company, start, 0 as topic, seq from (
                    select *, row_number() over (partition by company, start order by time, seq) as r from times where turn = 0) where r = 1""",
    )
    for t in range(1, SEED_TURNS):
        ctes[f"seeds{t}"] = f"""select * from seeds{t - 1} union all
            select company, start, {t} as topic, seq from (
              select i.company, i.start, i.seq, row_number() over (partition by i.company, i.start order by i.time / q.d, i.seq) as r
              from times i join (select s.company, s.start, p.a, min(p.d) as d from seeds{t - 1} s join pairs p on p.company = s.company and p.b = s.seq group by all) q
              on i.company = q.company and i.start = q.start and i.seq = q.a
              where i.turn = {t} and i.k > {t} and q.d > 0) where r = 1"""
    # The given centres of the Lloyd steps: the reviews of lowest number drawn.
    ctes["c0"] = """select f.company, f.topic, v.idx, v.x as w from (
        select company, seq, k, row_number() over (partition by company order by draw, seq) - 1 as topic from pts) f
        join xv v on v.company = f.company and v.seq = f.seq where f.topic < f.k"""
    ctes["tops"] = "select company, unnest(range(k)) as topic from able"
    for i in range(LLOYD_STEPS + 1):
        ctes[f"near{i}"] = f"""select company, seq, topic, dist from (
            select p.company, p.seq, t.topic, p.xx + coalesce(n.cc, 0) - 2 * coalesce(g.dot, 0) as dist,
                   row_number() over (partition by p.company, p.seq order by p.xx + coalesce(n.cc, 0) - 2 * coalesce(g.dot, 0), t.topic) as r
            from pts p join tops t on p.company = t.company
            left join (select company, topic, sum(w * w)::bigint as cc from c{i} group by all) n on n.company = t.company and n.topic = t.topic
            left join (select x.company, x.seq, c.topic, sum(x.x * c.w)::bigint as dot from xv x join c{i} c on x.company = c.company and x.idx = c.idx group by all) g
            on g.company = p.company and g.seq = p.seq and g.topic = t.topic) where r = 1"""
        ctes[f"c{i + 1}"] = f"""select s.company, s.topic, s.idx, ((2 * s.x + n.n) // (2 * n.n))::bigint as w
            from (select l.company, l.topic, v.idx, sum(v.x)::bigint as x from near{i} l join xv v on v.company = l.company and v.seq = l.seq group by all) s
            join (select company, topic, count(*) as n from near{i} group by all) n on n.company = s.company and n.topic = s.topic
            union all select * from c{i} where (company, topic) not in (select (company, topic) from near{i})"""
    return ctes


def _kmeans_sql(body: str, upto: str) -> str:
    """Only the CTEs up to one, each computed once."""
    ctes = _kmeans_ctes()
    names = list(ctes)
    used = {k: v for k, v in ctes.items() if names.index(k) <= names.index(upto) and (k[:5] != "seeds" or upto[:5] == "seeds")}
    sql = S.with_ctes(body, **used)
    for k in used:
        sql = sql.replace(f"\n{k} as (", f"\n{k} as materialized (", 1)
    return sql


def company_blocks(spark, sf_dir):
    vectors = stored(TP.topic_vectors(*company_words(spark, sf_dir)))
    return KM.Blocks(vectors), vectors


@register("topic_seeds", _kmeans_sql(f"select company, start, topic, seq from seeds{SEED_TURNS - 1}", f"seeds{SEED_TURNS - 1}"))
def q_topic_seeds(spark, sf_dir):
    """The reviews that every start of every company begins with."""
    ship_package(spark)
    blocks, _ = company_blocks(spark, sf_dir)
    return KM.seeds(blocks, CFG).select("company", "start", "topic", "seq")


def lloyd_steps(spark, sf_dir):
    ship_package(spark)
    blocks, vectors = company_blocks(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("company").orderBy("draw", "seq"))
    # The bound is a literal: a task keeps so many rows of a company before it sends them.
    first = vectors.withColumn("nth", nth).where(F.col("nth") <= SEED_TURNS).withColumn("topic", F.col("nth") - 1)
    given = KM.packed_centres(first.where(F.col("topic") < F.col("k")))
    return blocks, KM.lloyd(blocks, materialize(given), 1, LLOYD_STEPS)


@register("topic_lloyd", _kmeans_sql(
    f"""select c.company, cast(c.topic as integer) as topic, c.idx, c.w, t.cost from c{LLOYD_STEPS} c
        join (select company, sum(dist)::bigint as cost from near{LLOYD_STEPS - 1} group by company) t on t.company = c.company where c.w <> 0""", f"c{LLOYD_STEPS}"))
def q_topic_lloyd(spark, sf_dir):
    """Centres (in whole millionths) after three steps from given ones."""
    _, c = lloyd_steps(spark, sf_dir)
    w = KM.centre_weights(c.withColumn("cluster", F.col("topic"))).join(c.select("company", F.col("topic").alias("cluster"), "cost"), ["company", "cluster"])
    return w.select("company", F.col("cluster").alias("topic"), "cost", F.posexplode("weights").alias("idx", "w")).select(
        "company", "topic", "idx", F.round(F.col("w") * KM.UNIT).cast("long").alias("w"), "cost").where("w <> 0")


@register("topic_lloyd_labels", _kmeans_sql(
    f"select company, seq, cast(topic as integer) as cluster from near{LLOYD_STEPS}", f"near{LLOYD_STEPS}"))
def q_topic_lloyd_labels(spark, sf_dir):
    """Each review's nearest of those centres."""
    blocks, c = lloyd_steps(spark, sf_dir)
    return KM.nearest(blocks, c)


LABEL_SQL = "case when review_id is null then 0 else ascii(substring(review_id, 32, 1)) % 8 end"
K_FIXED = 8


def labelled_df(spark, sf_dir):
    """Reviews with a deterministic topic label taken from the identity, so
    the per-topic operators can be checked exactly."""
    return with_label(reviews_df(spark, sf_dir))


def with_label(reviews):
    lab = F.when(F.col("review_id").isNull(), F.lit(0)).otherwise(F.ascii(F.substring("review_id", 32, 1)) % 8)
    return reviews.withColumn("cluster", lab.cast("int"))


TOPIC_CTES = dict(
    FEATURE_CTES,
    lab=f"select *, cast({LABEL_SQL} as integer) as cluster from reviews",
    sizes="select cluster, count(*) as size from lab group by cluster",
    cw="""select s.cluster, v.idx, v.term,
                 round(coalesce((select sum(t.tfidf) from tfidf t join lab l on t.company = l.company and t.seq = l.seq
                                 where l.cluster = s.cluster and t.idx = v.idx), 0) / s.size, 9) as w
          from sizes s, vocab v""",
    summ=f"""select company, id, n_recensioni, n_recensioni / sum(n_recensioni) over (partition by company) * 100 as pct, rating_medio,
                    cast(row_number() over (partition by company order by n_recensioni desc, id) as integer) as rank
             from (select g.company, cast(g.id as integer) as id, coalesce(s.n, 0) as n_recensioni, s.m as rating_medio
                   from (select company, unnest(range({K_FIXED})) as id from (select distinct company from lab)) g
                   left join (select company, cluster, count(*) as n, avg(rating) filter (where rating <> 0) as m from lab group by all) s
                   on g.company = s.company and g.id = s.cluster)""",
    exs="""select company, cluster as id, cast(rn as integer) as example, seq
           from (select *, row_number() over (partition by company, cluster order by seq) as rn
                 from (select company, cluster, coalesce(review_id, '~null') as ident, min(seq) as seq from lab group by all))
           where rn <= 3""",
    top10="""select cluster, list(term order by rk) as top_terms from (
               select cluster, term, row_number() over (partition by cluster order by w desc, term desc) as rk from cw)
             where rk <= 10 group by cluster""",
    kept5="""select cluster, list_slice(list_filter(top_terms, lambda t: length(t) > 3 and not regexp_full_match(t, '\\p{Nd}+')), 1, 5) as parole_chiave
             from top10""",
)


@register("topic_terms", S.with_ctes(
    """select cluster, top_terms,
              list_slice(list_filter(top_terms, lambda t: length(t) > 3 and not regexp_full_match(t, '\\p{Nd}+')), 1, 5) as parole_chiave
       from top10""", **TOPIC_CTES))
def q_topic_terms(spark, sf_dir):
    rows, cents = fixed_centroids(spark, sf_dir)
    return TP.topic_terms(cents, rows)


def fixed_centroids(spark, sf_dir):
    """(vocabulary, centroids) of the deterministic topics, over all companies.
    The SQL side rounds the weights to 9 places, so that equal ones tie."""
    return centroids_of(with_label(stored_reviews(spark, sf_dir, "company", "seq", "review_id", "parole")))


def centroids_of(lab):
    """The same of written reviews."""
    rows = FT.vocab_rows(FT.vocabulary(lab, CFG))
    cents = TP.topic_centroids(lab, rows)
    return rows, materialize(cents.withColumn("weights", F.transform("weights", lambda x: F.round(x, 9))))


@register("topic_assign", S.with_ctes(
    """select company, seq, cast(cluster as integer) as cluster from (
         select company, seq, cluster, row_number() over (partition by company, seq order by dist, cluster) as rk from (
           select r.company, r.seq, n.cluster, round(coalesce(x.xx, 0) + n.ww - 2 * coalesce(x.xw, 0), 9) as dist
           from (select company, seq from reviews) r
           join (select cluster, sum(w * w) as ww from cw group by cluster) n on true
           left join (select t.company, t.seq, c.cluster, sum(t.tfidf * t.tfidf) as xx, sum(t.tfidf * c.w) as xw
                      from tfidf t join cw c on t.idx = c.idx group by all) x on r.company = x.company and r.seq = x.seq and n.cluster = x.cluster))
       where rk = 1""", **TOPIC_CTES))
def q_topic_assign(spark, sf_dir):
    """The nearest of given centroids for every review."""
    r = stored_reviews(spark, sf_dir, "company", "seq", "review_id", "parole")
    rows, cents = centroids_of(with_label(r))
    return TP.assign_nearest(r, cents, rows).select("company", "seq", "cluster")


@register("topic_summary", S.with_ctes("""
select company, id, n_recensioni, round(pct, 6) as percentuale, round(rating_medio, 6) as rating_medio, rank from summ""", **TOPIC_CTES))
def q_topic_summary(spark, sf_dir):
    s = TP.order_topics(TP.topic_summary(labelled_df(spark, sf_dir), K_FIXED))
    return s.withColumn("percentuale", r6("percentuale")).withColumn("rating_medio", r6("rating_medio"))


@register("topic_examples", S.with_ctes("""
select p.company, p.id, p.example, p.seq, r.review_id, r.testo, r.rating, r.data, r.link
from exs p join reviews r on p.company = r.company and p.seq = r.seq""", **TOPIC_CTES))
def q_topic_examples(spark, sf_dir):
    return TP.topic_examples(labelled_df(spark, sf_dir), K_FIXED, CFG)


# --- blocks ----------------------------------------------------------------------

from recensio.operators import blocks as BL  # noqa: E402

BLOCK_CTES = dict(
    offs="""select company, seq, cast(len(parole) as integer) as n_words,
                   coalesce(sum(len(parole)) over (partition by company order by seq rows between unbounded preceding and 1 preceding), 0) as "offset",
                   parole
            from reviews""",
    words="""select company, seq, "offset", unnest(parole) as word, unnest(generate_series(0, n_words - 1)) as i
             from offs where n_words > 0""",
    blocks=f"""select company, cast(("offset" + i) // {CFG.block_words} as bigint) as block_id, cast(count(*) as bigint) as n_words,
                      string_agg(word, ' ' order by "offset" + i) as testo
               from words group by 1, 2""",
)


@register("word_offsets", S.with_ctes('select company, seq, n_words, cast("offset" as bigint) as "offset" from offs', **BLOCK_CTES))
def q_word_offsets(spark, sf_dir):
    return BL.word_offsets(reviews_df(spark, sf_dir), CFG).select(
        "company", "seq", F.col("n_words").cast("int").alias("n_words"), F.col("offset").cast("long").alias("offset"))


@register("text_blocks", S.with_ctes("select company, block_id, n_words, testo from blocks", **BLOCK_CTES))
def q_text_blocks(spark, sf_dir):
    return BL.text_blocks(reviews_df(spark, sf_dir), CFG)


@register("block_count", S.with_ctes(
    f"select company, cast(coalesce(sum(len(parole)), 0) as bigint) as n_words, cast(ceil(coalesce(sum(len(parole)), 0) / {CFG.block_words}) as bigint) as n_blocks from reviews group by company"))
def q_block_count(spark, sf_dir):
    return BL.block_count(reviews_df(spark, sf_dir), CFG)


@register("prompts", S.with_ctes(
    f"select company, block_id, concat({S.q(BL.PROMPT_HEAD)}, testo, {S.q(BL.PROMPT_TAIL)}) as prompt from blocks", **BLOCK_CTES))
def q_prompts(spark, sf_dir):
    return BL.prompts(BL.text_blocks(reviews_df(spark, sf_dir), CFG))


# --- model answers and insight merge ---------------------------------------------

from recensio.config import INSIGHT_CATEGORIES, KEYWORD_BLACKLIST  # noqa: E402
from recensio.functions.text import SPACE  # noqa: E402
from recensio.operators import insights as IN  # noqa: E402
from recensio.plans import report as RP  # noqa: E402


def _items_sql(ci: int) -> str:
    n_items = 5 * len(INSIGHT_CATEGORIES)
    at = f"cast(floor(({ci * 5} + i) * len(words) / {n_items}) as integer)"
    return (f"list_filter(list_transform(range(0, 5), lambda i: concat_ws(' ', words[{at} + 1], "
            f"words[{at} + 2])), lambda x: x <> '')")


def _answer_sql() -> str:
    fields = []
    for ci, c in enumerate(INSIGHT_CATEGORIES):
        it = _items_sql(ci)
        if c == "parole_chiave":
            it = f"case when block_id % 2 = 0 then list_concat(['Offerte Maggio'], {it}) else {it} end"
        if c == "leve_marketing":
            it = f"case when block_id % 6 <> 5 then {it} end"
        if c == "suggerimenti_cro":
            it = f"case when company <> 'c5' then {it} end"
        fields.append(f"{c} := {it}")
    fields.append("sentiment_counts := struct_pack(positivo := block_id % 7 + 1, "
                  "neutro := case when block_id % 4 <> 1 then block_id % 3 end, negativo := block_id % 2)")
    return "to_json(struct_pack(" + ", ".join(fields) + "))"


_SHOWN = "case when block_id % 2 = 0 then concat('```json' || chr(10), js, chr(10) || '```') else js end"
_STRIP = ("regexp_replace(regexp_replace(content, '```json\\n?|```', '', 'g'), "
          + S.q(f"^[{SPACE}]+|[{SPACE}]+$") + ", '', 'g')")

INSIGHT_CTES = dict(
    BLOCK_CTES,
    resp_js=f"select company, block_id, cast({_answer_sql()} as varchar) as js from (select company, block_id, string_split(testo, ' ') as words from blocks)",
    responses=f"""
      select company, block_id, a.attempt, js || ' trailing' as content from resp_js, (values (1), (2), (3)) a(attempt) where block_id % 5 = 4
      union all select company, block_id, 1, '{{bad' from resp_js where block_id % 5 <> 4 and block_id % 3 = 0
      union all select company, block_id, 2, {_SHOWN} from resp_js where block_id % 5 <> 4 and block_id % 3 = 0
      union all select company, block_id, 1, {_SHOWN} from resp_js where block_id % 5 <> 4 and block_id % 3 <> 0""",
    parsed=f"""select company, block_id, attempt, cleaned,
                      json_valid(cleaned) and coalesce(json_type(case when json_valid(cleaned) then cleaned end), 'NULL') in ('OBJECT', 'ARRAY', 'VARCHAR') as valid from (select *, {_STRIP} as cleaned from responses)""",
    answers="""select p.company, p.block_id, p.attempt, p.cleaned from parsed p
               join (select company, block_id, min(attempt) as attempt from parsed where valid and attempt <= 3 group by all) f
               on p.company = f.company and p.block_id = f.block_id and p.attempt = f.attempt""",
    items=" union all ".join(
        f"""select company, block_id, '{c}' as categoria, unnest(generate_series(0, len(l) - 1)) as item_pos, unnest(l) as elemento
            from (select company, block_id, json_extract_string(cleaned, '$.{c}[*]') as l from answers)"""
        for c in INSIGHT_CATEGORIES),
    firsts="select company, categoria, elemento, min(block_id * 1000000 + item_pos) as k from items where elemento is not null group by all",
    kw_flag=f"""select *, not list_bool_or(list_transform({S.sql_list(KEYWORD_BLACKLIST)}, lambda t: contains(lower(elemento), t))) as allowed
                from firsts""",
    merged="""select company, categoria, cast(row_number() over (partition by company, categoria order by k) - 1 as bigint) as pos, elemento
              from kw_flag where categoria <> 'parole_chiave' or allowed""",
)


def answers_df(spark, sf_dir, reviews=None):
    r = reviews if reviews is not None else reviews_df(spark, sf_dir)
    resp = SRC.responses_from_blocks(BL.text_blocks(r, CFG, written=reviews is not None))
    return IN.first_valid(IN.parse_responses(resp), CFG)


def insights_df(spark, sf_dir, reviews=None):
    return IN.merge_insights(answers_df(spark, sf_dir, reviews), CFG)


@register("responses_parsed", S.with_ctes("select company, block_id, attempt, valid from parsed", **INSIGHT_CTES))
def q_responses_parsed(spark, sf_dir):
    resp = SRC.responses_from_blocks(BL.text_blocks(reviews_df(spark, sf_dir), CFG))
    return IN.parse_responses(resp).select("company", "block_id", "attempt", "valid")


@register("first_valid_attempt", S.with_ctes("select company, block_id, attempt from answers", **INSIGHT_CTES))
def q_first_valid_attempt(spark, sf_dir):
    return answers_df(spark, sf_dir).select("company", "block_id", "attempt")


@register("insight_merge", S.with_ctes("select company, categoria, pos, elemento from merged", **INSIGHT_CTES))
def q_insight_merge(spark, sf_dir):
    return insights_df(spark, sf_dir)


@register("keyword_blacklist", S.with_ctes(
    "select company, elemento, allowed from kw_flag where categoria = 'parole_chiave'", **INSIGHT_CTES))
def q_keyword_blacklist(spark, sf_dir):
    m = IN.merge_insights(answers_df(spark, sf_dir), CFG, blacklist=False).filter(F.col("categoria") == "parole_chiave")
    return m.select("company", "elemento", IN.keyword_allowed(F.col("elemento"), CFG.keyword_blacklist).alias("allowed"))


_SENT_SQL = ", ".join(
    f"cast(coalesce(sum(coalesce(json_extract(cleaned, '$.sentiment_counts.{s}')::bigint, 0)), 0) as bigint) as {s}"
    for s in ("positivo", "neutro", "negativo"))


@register("sentiment_distribution", S.with_ctes(f"select company, {_SENT_SQL} from answers group by company", **INSIGHT_CTES))
def q_sentiment_distribution(spark, sf_dir):
    return IN.sentiment_distribution(answers_df(spark, sf_dir))


@register("sentiment_share", S.with_ctes(f"""
select company, {', '.join(f"round(case when t > 0 then {s} / t * 100 else 0 end, 6) as {s}_pct" for s in ('positivo', 'neutro', 'negativo'))}
from (select *, positivo + neutro + negativo as t from (select company, {_SENT_SQL} from answers group by company)) where positivo > 0""", **INSIGHT_CTES))
def q_sentiment_share(spark, sf_dir):
    s = IN.sentiment_share(IN.sentiment_distribution(answers_df(spark, sf_dir)))
    return s.select("company", *[r6(c).alias(c) for c in s.columns if c != "company"])


# Themes taken from the merged answers: the full analysis chain.
MERGED_THEME_CTES = dict(
    INSIGHT_CTES,
    themes="select company, categoria as tipo, cast(pos as integer) as theme_pos, elemento as punto from merged where categoria in ('punti_forza', 'punti_debolezza')",
    th=THEME_CTES["th"], band=THEME_CTES["band"], matches=THEME_CTES["matches"], sizes=THEME_CTES["sizes"],
)


def merged_themes(insights):
    return insights.filter(F.col("categoria").isin(TH.STRENGTHS, TH.WEAKNESSES)).select(
        *RV.company_of(insights), F.col("categoria").alias("tipo"), F.col("pos").cast("int").alias("theme_pos"), F.col("elemento").alias("punto"))


@register("theme_keywords", S.with_ctes("select company, tipo, theme_pos, kw from th", **MERGED_THEME_CTES))
def q_theme_keywords(spark, sf_dir):
    th = TH.theme_keywords(merged_themes(insights_df(spark, sf_dir)))
    return th.select("company", "tipo", "theme_pos", "kw")


FREQ_SQL = """select c.company, c.tipo, c.theme_pos, c.punto, c."count", c."count" / s.band_rows * 100 as pct,
              round(c."count" / s.band_rows * 100, 6) as percentuale
       from (select company, tipo, theme_pos, punto, count(distinct ident) as "count" from matches group by all) c
       join sizes s on c.company = s.company and c.tipo = s.tipo"""


@register("analysis_theme_frequency", S.with_ctes(f"select * exclude (pct) from ({FREQ_SQL})", **MERGED_THEME_CTES))
def q_analysis_theme_frequency(spark, sf_dir):
    """Reviews -> blocks -> answers -> merged strengths/weaknesses -> how
    often each is mentioned."""
    r = chain_reviews(spark, sf_dir)
    f = TH.theme_frequency(r, merged_themes(insights_df(spark, sf_dir, r)), CFG, written=True)
    return f.withColumn("percentuale", r6("percentuale"))


# --- report tables ---------------------------------------------------------------

REPORT_CTES = dict(
    MERGED_THEME_CTES,
    freq=FREQ_SQL,
    lab=TOPIC_CTES["lab"],
)


@register("top_insights", S.with_ctes(
    "select company, categoria, pos, elemento from merged m join (values " +
    ", ".join(f"('{k}', {v})" for k, v in CFG.top_n.items() if k != "topics") +
    ") n(c, lim) on m.categoria = n.c where pos < lim", **REPORT_CTES))
def q_top_insights(spark, sf_dir):
    return RP.top_insights(insights_df(spark, sf_dir), CFG)


@register("report_general", S.with_ctes("""
select company, 'Leve Marketing' as categoria, coalesce(string_agg(elemento, ' | ' order by pos) filter (where categoria = 'leve_marketing' and pos < 10), '') as insights from merged group by company
union all
select company, 'Parole Chiave', coalesce(string_agg(elemento, ' | ' order by pos) filter (where categoria = 'parole_chiave' and pos < 20), '') from merged group by company""",
    **REPORT_CTES))
def q_report_general(spark, sf_dir):
    return RP.report_general(insights_df(spark, sf_dir), CFG)


@register("report_channels", S.with_ctes(
    "select k.company, cast(c.ord as integer) as ord, c.canale, m.pos, coalesce(m.elemento, '') as suggerimento from (select distinct company from merged) k, (values " +
    ", ".join(f"({i}, '{lab}', '{cat}')" for i, (lab, cat) in enumerate(RP.CHANNELS)) +
    ") c(ord, canale, categoria) left join merged m on k.company = m.company and c.categoria = m.categoria", **REPORT_CTES))
def q_report_channels(spark, sf_dir):
    return RP.report_channels(insights_df(spark, sf_dir))


@register("report_themes", S.with_ctes("""
select company, tipo, cast(row_number() over (partition by company, tipo order by "count" desc, theme_pos) as integer) as rank, punto, "count", percentuale,
       printf('%.1f%%', pct) as percentuale_txt
from freq""", **REPORT_CTES))
def q_report_themes(spark, sf_dir):
    r = chain_reviews(spark, sf_dir)
    f = TH.theme_frequency(r, merged_themes(insights_df(spark, sf_dir, r)), CFG, written=True)
    return RP.report_themes(f).withColumn("percentuale", r6("percentuale"))


@register("themes_with_fallback", S.with_ctes("""
select company, tipo, rank, punto, 'frequenza' as source from (
  select company, tipo, cast(row_number() over (partition by company, tipo order by "count" desc, theme_pos) as integer) as rank, punto from counted) where rank <= 10
union all
select company, categoria, cast(pos + 1 as integer), elemento, 'elenco' from merged m
where categoria in ('punti_forza', 'punti_debolezza') and pos < 10
  and not exists (select 1 from counted f where f.company = m.company and f.tipo = m.categoria)""",
    **REPORT_CTES, counted="select * from freq where not (company in ('c3', 'c4') and tipo = 'punti_debolezza')"))
def q_themes_with_fallback(spark, sf_dir):
    r = chain_reviews(spark, sf_dir)
    ins = insights_df(spark, sf_dir, r)
    f = TH.theme_frequency(r, merged_themes(ins), CFG, written=True)
    # Two companies without any frequency of one type show the plain list.
    f = f.filter(~(F.col("company").isin("c3", "c4") & (F.col("tipo") == "punti_debolezza")))
    return RP.themes_with_fallback(f, ins, CFG)


@register("headline", S.with_ctes("""
select r.company, r.n_recensioni, r.rating_medio, coalesce(m.f, 0) as n_punti_forza, coalesce(m.d, 0) as n_punti_debolezza, coalesce(t.n, 0) as n_cluster
from (select company, count(*) as n_recensioni, round(avg(rating) filter (where rating <> 0), 6) as rating_medio from reviews group by company) r
left join (select company, count(*) filter (where categoria = 'punti_forza') as f, count(*) filter (where categoria = 'punti_debolezza') as d
           from merged group by company) m on r.company = m.company
left join (select company, count(distinct cluster) as n from lab group by company) t on r.company = t.company""", **REPORT_CTES))
def q_headline(spark, sf_dir):
    r = chain_reviews(spark, sf_dir)
    topics = TP.topic_summary(with_label(r), K_FIXED).filter("n_recensioni > 0")  # the topics that hold reviews
    h = RP.headline(r, insights_df(spark, sf_dir, r), topics)
    return h.withColumn("rating_medio", r6("rating_medio"))


@register("report_reviews", S.with_ctes(
    "select company, seq, testo, rating, data, cast(cluster as varchar) as cluster, link from lab", **REPORT_CTES))
def q_report_reviews(spark, sf_dir):
    return RP.report_reviews(labelled_df(spark, sf_dir))


def topic_rows_df(spark, sf_dir):
    lab = with_label(stored_reviews(spark, sf_dir))
    rows, cents = centroids_of(lab)
    return TP.topic_rows(lab, cents, rows, K_FIXED, CFG)


@register("topic_rows", S.with_ctes("""
select s.company, s.rank, s.id, coalesce(t.parole_chiave, []) as parole_chiave, s.n_recensioni, round(s.pct, 6) as percentuale,
       round(s.rating_medio, 6) as rating_medio, coalesce(e.esempi, []) as esempi
from summ s left join kept5 t on s.id = t.cluster
left join (select company, id, list(seq order by example) as esempi from exs group by all) e on s.company = e.company and s.id = e.id""", **TOPIC_CTES))
def q_topic_rows(spark, sf_dir):
    t = topic_rows_df(spark, sf_dir)
    return t.withColumns({"percentuale": r6("percentuale"), "rating_medio": r6("rating_medio"), "esempi": F.transform("esempi", lambda e: e["seq"])})


@register("report_topics", S.with_ctes("""
select s.company, s.rank, s.id, array_to_string(coalesce(t.parole_chiave, []), ', ') as tematica, s.n_recensioni, round(s.pct, 6) as percentuale,
       round(s.rating_medio, 6) as rating_medio, printf('%.1f%%', s.pct) as percentuale_txt, coalesce(printf('%.1f', s.rating_medio), 'N/A') as rating_medio_txt
from summ s left join kept5 t on s.id = t.cluster""", **TOPIC_CTES))
def q_report_topics(spark, sf_dir):
    s = RP.report_topics(topic_rows_df(spark, sf_dir))
    return s.withColumns({"percentuale": r6("percentuale"), "rating_medio": r6("rating_medio")})


@register("top_topics", S.with_ctes("select company, rank, id, n_recensioni from summ where rank <= 5", **TOPIC_CTES))
def q_top_topics(spark, sf_dir):
    return RP.top_topics(topic_rows_df(spark, sf_dir), CFG).select("company", "rank", "id", "n_recensioni")


@register("example_cards", S.with_ctes("""
select p.company, p.tipo, p.theme_pos, p.punto, cast(p.example as integer) as example,
       repeat('⭐', case when r.rating is not null and r.rating <> 0 then r.rating else 3 end) as stelle,
       case when length(r.testo) > 200 then left(r.testo, 200) || '...' else r.testo end as testo_breve,
       r.data, r.link,
       case when p.tipo = 'punti_forza' then 'positive-review' else 'negative-review' end as classe
from (select *, row_number() over (partition by company, tipo, theme_pos, punto order by seq) as example
      from (select company, tipo, theme_pos, punto, ident, min(seq) as seq from matches where nkw > 0 group by all)) p
join reviews r on p.company = r.company and p.seq = r.seq
where p.example <= 2""", **THEME_CTES))
def q_example_cards(spark, sf_dir):
    ex = TH.theme_examples(reviews_df(spark, sf_dir), SRC.fixed_themes(spark), LITERAL_THEMES)
    return RP.example_cards(ex)


# --- pages: scan, predicates, crawl prefix, HTML walk ----------------------------

from recensio.sources import pages as PG  # noqa: E402

PAGES_SQL = """
select 'c' || cast(page_id // 10 as varchar) as company, cast(page_id % 10 + 1 as integer) as pagina,
       'https://reviews.example/review/c' || cast(page_id // 10 as varchar) || '?page=' || cast(page_id % 10 + 1 as varchar) as url,
       cast(case when page_id % 23 = 7 then 404 when page_id % 19 = 4 then null else 200 end as integer) as status, html, page_id,
       page_id % 10 = 0 and page_id // 10 % 4 = 1 as bare
from pages"""
# The listing's containers: the driver page's own articles (their number
# follows from the start tags), then the two that the fixture adds.
ARTICLES = "len(regexp_extract_all(html, " + S.q(r"(?i)<article[\s>/]") + "))"
PAGE_CTES = dict(
    lp=PAGES_SQL,
    stops="select company, min(pagina) filter (where status is not null and status <> 200) as stop_at from lp group by company",
    kept="""select lp.* from lp join stops using (company)
            where status is not null and (stop_at is null or pagina < stop_at)""",
    arts=f"select *, case when bare then 0 else {ARTICLES} + 2 end as n from kept",
    found=f"""select company, pagina, url, page_id, n, cast(unnest(generate_series(0, n - 1)) as integer) as pos from arts where n > 0""",
    conts="""select company, pagina, url, pos,
                    case when pos < n - 2 then cast(page_id % 5 + 1 as varchar) when pos = n - 1 then '5' when page_id % 13 = 5 then 'five' else '2' end as rating_attr,
                    case when pos < n - 2 and page_id % 7 <> 3 then 'p' || cast(page_id as varchar) end as m2_id,
                    case when pos = n - 2 then 'k' || cast(page_id as varchar) end as m5_id, pos = n - 1 as short
             from found""",
    guarded="""select * from conts where company not in (select company from arts where pagina = 1 and n = 0)""",
    page_reviews="select *, coalesce(m2_id, m5_id) as review_id from guarded where not short and rating_attr <> 'five'",
)


@register("company_key", S.with_ctes(f"""select page_id, regexp_extract(url, {S.q('/review/([^/?]+)')}, 1) as company_key from lp
union all select page_id, '' from pages""", **PAGE_CTES))
def q_company_key(spark, sf_dir):
    p = PG.pages_from_table(spark, sf_dir).select("page_id", "url").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return p.select("page_id", PG.company_key(F.col("url")).alias("company_key"))


@register("url_filter", "select page_id, url from pages where length(url) > 0 and contains(url, 'example.com')")
def q_url_filter(spark, sf_dir):
    return PG.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), "example.com").select("page_id", "url")


@register("crawl_prefix", S.with_ctes("select company, pagina, status from kept", **PAGE_CTES))
def q_crawl_prefix(spark, sf_dir):
    return PG.crawl_prefix(PG.pages_from_table(spark, sf_dir)).select("company", "pagina", "status")


@register("review_containers", S.with_ctes("select company, pagina, pos, rating_attr, m2_id, m5_id from conts", **PAGE_CTES))
def q_review_containers(spark, sf_dir):
    """HTML walk over the kept pages."""
    kept = PG.crawl_prefix(PG.pages_from_table(spark, sf_dir))
    return PG.extract_containers(kept, CFG).select("company", "pagina", "pos", "rating_attr", "m2_id", "m5_id")


@register("first_page_guard", S.with_ctes("select company, pagina, pos from guarded", **PAGE_CTES))
def q_first_page_guard(spark, sf_dir):
    walked = PG.walk_pages(PG.crawl_prefix(PG.pages_from_table(spark, sf_dir)), CFG)
    return PG.first_page_guard(walked).select("company", "pagina", "pos")


def _visible_sql(inner: str) -> str:
    """The text of a piece of the driver's markup: what stands between tags,
    stripped, joined by one space (its articles hold no comments, scripts or
    entities but quotes and ampersands)."""
    strip = lambda x: f"regexp_replace(regexp_replace(replace({x}, '&quot;', chr(34)), '&amp;?', '&', 'g'), {S.q('^[' + SPACE + ']+|[' + SPACE + ']+$')}, '', 'g')"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({inner}, '<[^>]*>'), lambda x: {strip('x')}), lambda x: x <> ''), ' ')"


OWN_ARTICLES = "regexp_extract_all(html, " + S.q(r"(?is)<article[\s>/].*?</article>") + ")"


@register("html_reviews", S.with_ctes(f"""
select r.company, r.pagina, r.pos, r.review_id, cast(r.rating_attr as integer) as rating,
       case when r.review_id is not null then {S.q(CFG.link_base)} || r.review_id else r.url end as link,
       case when r.pos = a.n - 2 then 'Consegna del pacco numero ' || cast(a.page_id as varchar) || ' arrivata in ritardo, assistenza lenta e rimborso negato'
            else {_visible_sql('a.own[r.pos + 1]')} || ' Recensione lasciata dopo un acquisto fatto nel negozio online' end as testo
from page_reviews r join (select *, {OWN_ARTICLES} as own from arts) a on r.company = a.company and r.pagina = a.pagina""", **PAGE_CTES))
def q_html_reviews(spark, sf_dir):
    """pages -> reviews through the whole extraction path."""
    raw = PG.raw_from_pages(PG.pages_from_table(spark, sf_dir), CFG)
    return RV.to_reviews(raw, CFG).select("company", "pagina", "pos", "review_id", "rating", "link", "testo")


@register("html_fallback", f"""
with pg as (select 'f' || cast(page_id // 10 as varchar) as company, cast(page_id % 10 + 1 as integer) as pagina, page_id, {OWN_ARTICLES} as own
            from pages where page_id % 6 <> 5),
bare as (select distinct 'f' || cast(page_id // 10 as varchar) as company from pages where page_id % 6 = 5 and page_id % 10 = 0),
c as (select *, unnest(range(3 * len(own))) as pos from pg where company not in (select company from bare)),
t as (select company, pagina, cast(pos as integer) as pos,
             case when pos % 3 = 2 then 'Valutato 3 stelle su 5 Acquisto numero ' || cast(page_id as varchar) || ', consegna puntuale e imballo curato'
                  else {_visible_sql('own[pos // 3 + 1]')} end as testo from c)
select company, pagina, pos, {S.rating_from_text_sql('testo')} as rating, testo from t where length(testo) >= 50""")
def q_html_fallback(spark, sf_dir):
    """Pages without rated containers: the fallback selectors, nested hits
    each a record, the rating from the text."""
    raw = PG.raw_from_pages(PG.fallback_pages_from_table(spark, sf_dir), CFG)
    return RV.to_reviews(raw, CFG).select("company", "pagina", "pos", "rating", "testo")


@register("page_stats", S.with_ctes("""
select company, count(*) as n_recensioni, count(*) as n_con_rating, round(avg(cast(rating_attr as integer)), 6) as rating_medio
from page_reviews group by company""", **PAGE_CTES))
def q_page_stats(spark, sf_dir):
    """Corpus statistics of many companies straight from their pages."""
    raw = PG.raw_from_pages(PG.pages_from_table(spark, sf_dir), CFG)
    return RP.corpus_stats(RV.to_reviews(raw, CFG)).withColumn("rating_medio", r6("rating_medio"))


ID_COLS_SQL = """
select page_id,
       case when page_id % 7 = 0 then url when page_id % 7 = 1 then 'x/' end as m1_url,
       case when page_id % 7 in (1, 2) then 'svc' || cast(page_id as varchar) end as m2_id,
       case when page_id % 7 = 3 then '/reviews/t' || cast(page_id as varchar) || '?a=1' when page_id % 7 = 4 then url end as m3_href,
       case when page_id % 7 in (4, 5) then '/it/reviews/h' || cast(page_id as varchar) || '?b#c' end as m4_href,
       case when page_id % 7 = 6 and page_id % 2 = 0 then 'cons' || cast(page_id as varchar) when page_id % 7 = 6 then '' end as m5_id
from pages"""


def _id_cols(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pid, m = F.col("page_id"), F.col("page_id") % 7
    s = pid.cast("string")
    return p.select(
        "page_id",
        F.when(m == 0, F.col("url")).when(m == 1, F.lit("x/")).alias("m1_url"),
        F.when(m.isin(1, 2), F.concat(F.lit("svc"), s)).alias("m2_id"),
        F.when(m == 3, F.concat(F.lit("/reviews/t"), s, F.lit("?a=1"))).when(m == 4, F.col("url")).alias("m3_href"),
        F.when(m.isin(4, 5), F.concat(F.lit("/it/reviews/h"), s, F.lit("?b#c"))).alias("m4_href"),
        F.when((m == 6) & (pid % 2 == 0), F.concat(F.lit("cons"), s)).when(m == 6, F.lit("")).alias("m5_id"),
    )


@register("review_id_chain", f"""
with ids as ({ID_COLS_SQL})
select page_id, coalesce(
  nullif(case when coalesce(m1_url, '') <> '' then string_split(m1_url, '/')[-1] end, ''),
  nullif(m2_id, ''),
  nullif(case when contains(m3_href, '/reviews/') then string_split(string_split(m3_href, '/reviews/')[-1], '?')[1] end, ''),
  nullif(case when contains(m4_href, '/reviews/') then string_split(string_split(string_split(m4_href, '/reviews/')[-1], '?')[1], '#')[1] end, ''),
  m5_id) as review_id
from ids""")
def q_review_id_chain(spark, sf_dir):
    c = _id_cols(spark, sf_dir)
    return c.select("page_id", PG.review_id_chain(*[F.col(x) for x in ("m1_url", "m2_id", "m3_href", "m4_href", "m5_id")]).alias("review_id"))


@register("topic_cards", S.with_ctes("""
select s.company, s.rank, s.id, s.id + 1 as titolo, array_to_string(list_slice(coalesce(t.parole_chiave, []), 1, 3), ', ') as tematiche, round(s.pct, 6) as percentuale,
       e.example,
       case when e.example is not null then repeat('⭐', case when r.rating is not null and r.rating <> 0 then r.rating else 3 end) end as stelle,
       case when length(r.testo) > 150 then left(r.testo, 150) || '...' else r.testo end as testo_breve, r.link
from summ s left join kept5 t on s.id = t.cluster
left join (select * from exs where example <= 2) e on s.company = e.company and s.id = e.id
left join reviews r on e.company = r.company and e.seq = r.seq""", **TOPIC_CTES))
def q_topic_cards(spark, sf_dir):
    return RP.topic_cards(topic_rows_df(spark, sf_dir)).withColumn("percentuale", r6("percentuale"))


JSON_CTES = dict(
    TOPIC_CTES, **{k: v for k, v in REPORT_CTES.items() if k not in TOPIC_CTES and k not in ("sizes", "freq")},
    bsizes=THEME_CTES["sizes"], freq=FREQ_SQL.replace("join sizes s", "join bsizes s"),
)
URL = "https://reviews.example/review/{company}"


def whole_chain(spark, sf_dir):
    """(reviews, answers, insights, topics, frequencies), labels from the
    identity.  Cleaned once: blocks, themes, topics and statistics read one
    written table."""
    r = stored_reviews(spark, sf_dir)
    answers = materialize(answers_df(spark, sf_dir, r))
    ins = materialize(IN.merge_insights(answers, CFG))
    lab = with_label(r)
    rows = FT.vocab_rows(FT.vocabulary(r, CFG))
    topics = TP.topic_rows(lab, TP.topic_centroids(lab, rows), rows, K_FIXED, CFG)
    return r, answers, ins, topics, TH.theme_frequency(r, merged_themes(ins), CFG, written=True)


@register("report_json", S.with_ctes(f"""
select st.company, 'metadati' as sezione, cast(st.n as varchar) as a, cast(coalesce(t.n, 0) as varchar) as b, replace({S.q(URL)}, '{{company}}', st.company) as c, round(st.m, 6) as x
from (select company, count(*) as n, avg(rating) filter (where rating <> 0) as m from reviews group by company) st
left join (select company, count(*) as n from summ group by company) t on st.company = t.company
union all select company, 'sentiment', cast(positivo as varchar), cast(neutro as varchar), cast(negativo as varchar), null from (select company, {_SENT_SQL} from answers group by company)
union all select company, 'tematica', cast(rank as varchar), cast(id as varchar), cast(n_recensioni as varchar), round(pct, 6) from summ
union all select company, 'insight', categoria, cast(pos as varchar), elemento, null from merged
union all select company, 'tema', tipo, cast(rank as varchar), punto, round(pct, 6)
from (select *, row_number() over (partition by company, tipo order by "count" desc, theme_pos) as rank from freq) where rank <= 20""", **JSON_CTES))
def q_report_json(spark, sf_dir):
    """The JSON Lines report of every company over the whole chain (labels
    from the identity), read back from its JSON text."""
    r, answers, ins, topics, freq = whole_chain(spark, sf_dir)
    lines = RP.report_json(RP.corpus_stats(r), topics, ins, IN.sentiment_distribution(answers), freq, URL)
    get = lambda p: F.get_json_object("json", f"$.{p}")
    s = get("sezione")
    pick = lambda *names: F.coalesce(*[F.when(s == sec, get(n)) for sec, n in zip(("metadati", "sentiment", "tematica", "insight", "tema"), names)])
    return lines.select(
        get("company").alias("company"), s.alias("sezione"),
        pick("n_recensioni", "positivo", "rank", "categoria", "tipo").alias("a"), pick("n_cluster", "neutro", "id", "pos", "rank").alias("b"),
        pick("url_analizzato", "negativo", "n_recensioni", "elemento", "punto").alias("c"),
        r6(F.when(s.isin("tematica", "tema"), get("percentuale")).when(s == "metadati", get("rating_medio")).cast("double")).alias("x"))


# --- exports -----------------------------------------------------------------------

from recensio.plans import export as EX  # noqa: E402


def report_document(spark, sf_dir):
    """The rows of the JSON document over the whole chain; numbers at six
    places, so that both engines print them alike."""
    r, answers, ins, topics, freq = whole_chain(spark, sf_dir)
    topics = topics.withColumns({"percentuale": r6("percentuale"), "rating_medio": r6("rating_medio")})
    stats = RP.corpus_stats(r).withColumn("rating_medio", r6("rating_medio"))
    return EX.json_document(stats, topics, ins, IN.sentiment_distribution(answers), freq.withColumn("percentuale", r6("percentuale")), URL)


def _document_sql() -> str:
    after = "case when {0} > 0 then ',' else '' end || "
    parts = []

    def add(table: str, pos: str, text: str) -> None:
        parts.append(f"select 1 as blocco, company, {len(parts)} as parte, cast({pos} as bigint) as pos, {text} as testo from {table}")

    add("""(select h.*, coalesce(t.n, 0)::bigint as k, row_number() over (order by h.company) as nth from heads h left join (select company, count(*) as n from summ group by company) t using (company))""", "0",
        f"""case when nth > 1 then ',' else '' end || to_json(company) || ':{{"metadata":' ||
            to_json(struct_pack(n_recensioni := n, rating_medio := round(m, 6), n_clusters := k, url_analizzato := replace({S.q(URL)}, '{{company}}', company))) || ',"clusters":['""")
    add("(select s.*, coalesce(t.parole_chiave, []) as kw from summ s left join kept5 t on s.id = t.cluster)", "rank - 1", after.format("rank - 1") +
        "to_json(struct_pack(id := id, tematiche := kw, percentuale := round(pct, 6), rating_medio := round(rating_medio, 6)))")
    for i, cat in enumerate(INSIGHT_CATEGORIES):
        lead = '],"insights":{' if i == 0 else "],"
        add("heads", "0", S.q(f'{lead}"{cat}":['))
        add(f"(select * from merged where categoria = '{cat}')", "pos", after.format("pos") + "to_json(elemento)")
    add("(select h.company, s.* exclude (company) from heads h left join sent s using (company))", "0",
        """'],"sentiment_distribution":' || to_json(struct_pack(positivo := coalesce(positivo, 0), neutro := coalesce(neutro, 0), negativo := coalesce(negativo, 0))) || '}'""")
    for tipo, lead in (("punti_forza", ',"frequenze":{'), ("punti_debolezza", "},")):
        add("heads", "0", S.q(f'{lead}"{tipo}":{{'))
        add(f"""(select *, row_number() over (partition by company order by "count" desc, theme_pos) as rank from freq where tipo = '{tipo}' qualify rank <= 20)""", "rank - 1",
            after.format("rank - 1") + """to_json(punto) || ':' || to_json(struct_pack("count" := "count", percentuale := percentuale))""")
    add("heads", "0", "'}}}'")
    ends = "select 0 as blocco, cast(null as varchar) as company, 0 as parte, cast(0 as bigint) as pos, '{' as testo union all select 2, null, 0, 0, '}'"
    return S.with_ctes("\nunion all ".join([ends, *parts]), **JSON_CTES,
                       heads="select company, count(*) as n, avg(rating) filter (where rating <> 0) as m from reviews group by company",
                       sent=f"select company, {_SENT_SQL} from answers group by company")


@register("report_document", _document_sql())
def q_report_document(spark, sf_dir):
    """Every row of the JSON document, with its place."""
    return report_document(spark, sf_dir)


SHEET_TEXT = dict(recensioni="testo", tematiche="tematica", punti_forza="punto", punti_debolezza="punto", analisi_generale="insights", canali="suggerimento")


@register("report_export", S.with_ctes("""
select 'recensioni' as foglio, company, count(*) as righe, sum(length(testo))::bigint as caratteri from reviews group by company
union all select 'tematiche', company, count(*), sum(length(array_to_string(coalesce(t.parole_chiave, []), ', ')))::bigint from summ s left join kept5 t on s.id = t.cluster group by company
union all select tipo, company, count(*), sum(length(punto))::bigint from freq group by tipo, company
union all select 'analisi_generale', company, 2, sum(length(insights))::bigint from ({general}) group by company
union all select 'canali', company, count(*), sum(length(suggerimento))::bigint from ({channels}) group by company""".format(
    general=ORACLE["report_general"], channels=ORACLE["report_channels"]), **JSON_CTES))
def q_report_export(spark, sf_dir):
    """The six sheets written as one export and read back: rows and letters
    of every sheet and company."""
    from uuid import uuid4

    r, answers, ins, topics, freq = whole_chain(spark, sf_dir)
    freq = materialize(freq)
    themes = RP.report_themes(freq)
    sheets = {
        "recensioni": RP.report_reviews(with_label(r)), "tematiche": RP.report_topics(topics),
        "punti_forza": themes.filter(F.col("tipo") == TH.STRENGTHS), "punti_debolezza": themes.filter(F.col("tipo") == TH.WEAKNESSES),
        "analisi_generale": RP.report_general(ins, CFG), "canali": RP.report_channels(ins),
    }
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid4().hex}"
    EX.export_report(spark, sheets, path)
    back = EX.Export(spark, path).tables()
    counted = [back[k].groupBy("company").agg(F.count(F.lit(1)).alias("righe"), F.sum(F.length(c)).cast("long").alias("caratteri")).select(F.lit(k).alias("foglio"), "company", "righe", "caratteri")
               for k, c in SHEET_TEXT.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out

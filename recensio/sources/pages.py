"""Review pages -> raw review records.

``pages(company, pagina, url, status, html)``: one row per fetched listing
page (``status`` NULL when the request failed).  Steps:

* ``crawl_prefix``: per company keep the pages before the first page whose
  status is not 200, drop failed requests (a partial aggregate per company
  joined back: no window holds a whole company);
* ``walk_pages``: the HTML walk, ``mapInPandas`` over pages (the only Python
  in the path, one page at a time, Arrow batches), done once and written;
  a container that cannot be read is kept with its error;
* ``first_page_guard``: a company whose first page was fetched but holds no
  container yields no rows at all;
* ``to_raw``: id chain and link inputs as Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.functions import html as H
from recensio.session import materialize, ship_package

CONTAINER_SCHEMA = (
    "company string, pagina int, page_url string, pos int, testo string, rating_attr string, "
    "rating_div string, m1_url string, m2_id string, m3_href string, m4_href string, m5_id string, error string"
)
_FIELDS = ("testo", "rating_attr", "rating_div", "m1_url", "m2_id", "m3_href", "m4_href", "m5_id")
SEQ_PAGE = 1 << 20  # seq = pagina * SEQ_PAGE + pos, unique within a company


def company_key(url: Column) -> Column:
    """The company part of a review-site URL, '' when there is none."""
    return F.regexp_extract(url, r"/review/([^/?]+)", 1)


def url_filter(pages: DataFrame, host: str) -> DataFrame:
    """Keep pages whose URL is non-empty and names ``host``."""
    return pages.filter((F.length("url") > 0) & F.col("url").contains(host))


def crawl_prefix(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages read by a crawl that stops at the first non-200 page; failed
    requests (NULL status) are skipped."""
    p = pages if max_pages is None else pages.filter(F.col("pagina") <= max_pages)
    stop = p.groupBy("company").agg(
        F.min(F.when(F.col("status").isNotNull() & (F.col("status") != 200), F.col("pagina"))).alias("stop_at")
    )
    return (
        p.join(stop, "company")
        .filter(F.col("status").isNotNull() & (F.col("stop_at").isNull() | (F.col("pagina") < F.col("stop_at"))))
        .drop("stop_at")
    )


def _walk(cfg: Config):
    primary, fallback = cfg.primary_attr, cfg.fallback_selectors
    names = ["company", "pagina", "page_url", "pos", *_FIELDS, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Arrow batches are bounded in bytes by the session; records leave 64
        # pages at a time.
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i:i + 64]
                rows = [(company, pagina, url, pos, *((rec or {}).get(f) for f in _FIELDS), error)
                        for company, pagina, url, html in zip(part["company"], part["pagina"], part["url"], part["html"])
                        for pos, rec, error in H.page_records(html, primary, fallback)]
                out = pd.DataFrame(rows, columns=names)
                out["pos"] = out["pos"].astype("Int32")
                yield out

    return run


def walk_pages(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The HTML walk, written once: a row per review container (``pos`` = its
    place on the page), and a row without ``pos`` for a page without any."""
    ship_package(pages.sparkSession)
    return materialize(pages.select("company", "pagina", "url", "html").mapInPandas(_walk(cfg), CONTAINER_SCHEMA))


def extract_containers(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per review container that could be read."""
    return walk_pages(pages, cfg).filter(F.col("pos").isNotNull() & F.col("error").isNull()).drop("error")


def first_page_guard(walked: DataFrame) -> DataFrame:
    """The containers (and failures) of ``walk_pages``, without every company
    whose page 1 was read and has no container."""
    empty_first = walked.filter((F.col("pagina") == 1) & F.col("pos").isNull() & F.col("error").isNull()).select("company").distinct()
    return walked.filter(F.col("pos").isNotNull() | F.col("error").isNotNull()).join(empty_first, "company", "left_anti")


def review_id_chain(m1: Column, m2: Column, m3: Column, m4: Column, m5: Column) -> Column:
    """First non-empty of: last path part of the review URL attribute; the
    service id attribute; the /reviews/ link around the first timestamp
    (up to '?'); the first /reviews/ link (up to '?' and '#'); the consumer
    id attribute (taken as is)."""
    def ne(c):
        return F.nullif(c, F.lit(""))

    def tail(href, cut_hash):
        t = F.substring_index(F.substring_index(href, "/reviews/", -1), "?", 1)
        return F.substring_index(t, "#", 1) if cut_hash else t

    c1 = F.when(ne(m1).isNotNull(), F.substring_index(m1, "/", -1))
    c3 = F.when(m3.contains("/reviews/"), tail(m3, False))
    c4 = F.when(m4.contains("/reviews/"), tail(m4, True))
    return F.coalesce(ne(c1), ne(m2), ne(c3), ne(c4), m5)


def to_raw(containers: DataFrame) -> DataFrame:
    """Raw review records in the shape ``operators.reviews`` reads."""
    rid = review_id_chain(F.col("m1_url"), F.col("m2_id"), F.col("m3_href"), F.col("m4_href"), F.col("m5_id"))
    return containers.select(
        "company",
        (F.col("pagina").cast("long") * SEQ_PAGE + F.col("pos")).alias("seq"),
        "pagina", "pos", "page_url", rid.alias("review_id"), "rating_attr", "rating_div", "testo", "error",
    )


def raw_from_pages(pages: DataFrame, cfg: Config = Config(), max_pages: int | None = None) -> DataFrame:
    """pages -> raw review records (crawl prefix, walk, guard, id chain)."""
    return to_raw(first_page_guard(walk_pages(crawl_prefix(pages, max_pages), cfg)))


def pages_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``pages(page_id, url, html)`` as listing pages: ten pages
    per company, some failed requests and error statuses.  Each page's own
    article gets a rating and, mostly, an id; two more reviews follow it, some
    with a rating that is no number, and a short one.  Some companies' first
    pages hold no container at all."""
    from recensio.sources.tables import read_table, spread

    p = spread(read_table(spark, sf_dir, "pages"))
    pid = F.col("page_id")
    text = pid.cast("string")
    company = F.concat(F.lit("c"), F.floor(pid / 10).cast("string"))
    pagina = (pid % 10 + 1).cast("int")
    status = F.when(pid % 23 == 7, F.lit(404)).when(pid % 19 == 4, F.lit(None)).otherwise(F.lit(200))
    marks = F.concat(F.lit('<article data-service-review-rating="'), (pid % 5 + 1).cast("string"), F.lit('"'),
                     F.when(pid % 7 == 3, F.lit("")).otherwise(F.concat(F.lit(' data-service-review-id="p'), text, F.lit('"'))))
    more = F.concat(
        F.lit('<article data-service-review-rating="'), F.when(pid % 13 == 5, F.lit("five")).otherwise(F.lit("2")),
        F.lit('" data-consumer-review-id="k'), text, F.lit('"><p>Consegna del pacco numero '), text,
        F.lit(" arrivata in ritardo, assistenza lenta e rimborso negato</p></article>"),
        F.lit('<article data-service-review-rating="5"><p>troppo corto</p></article>'))
    listing = F.when((pid % 10 == 0) & (F.floor(pid / 10) % 4 == 1), F.lit("<html><body><p>no reviews here</p></body></html>")).otherwise(
        F.concat(F.replace(F.replace(F.col("html"), F.lit("<article"), marks), F.lit("</article>"),
                           F.lit("<p>Recensione lasciata dopo un acquisto fatto nel negozio online</p></article>")), more))
    return p.select(
        company.alias("company"), pagina.alias("pagina"),
        F.concat(F.lit("https://reviews.example/review/"), company, F.lit("?page="), pagina.cast("string")).alias("url"),
        status.cast("int").alias("status"), listing.alias("html"), "page_id")


def fallback_pages_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages as listing pages of another layout: no container
    has the rating attribute, so the fallback selectors count.  Each page's
    own article lies in a section, both of them containers, and a review with
    unclosed tags follows; every sixth page has no container at all."""
    from recensio.sources.tables import read_table, spread

    p = spread(read_table(spark, sf_dir, "pages"))
    pid = F.col("page_id")
    company = F.concat(F.lit("f"), F.floor(pid / 10).cast("string"))
    more = F.concat(F.lit('</article></section><div class="box review-content"><b>Valutato 3 stelle su 5<p>Acquisto numero '), pid.cast("string"),
                    F.lit(", consegna puntuale<br>e imballo curato<script>var x = 1;</script></div>"))
    listing = F.when(pid % 6 == 5, F.lit("<html><body><p>no reviews here</p></body></html>")).otherwise(
        F.replace(F.replace(F.col("html"), F.lit("<article"), F.lit('<section class="x reviewContentwrapper"><article class="card review-card"')), F.lit("</article>"), more))
    return p.select(company.alias("company"), (pid % 10 + 1).cast("int").alias("pagina"), F.concat(F.lit("https://reviews.example/f?page="), pid.cast("string")).alias("url"),
                    F.lit(200).alias("status"), listing.alias("html"))

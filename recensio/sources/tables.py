"""Review-shaped inputs derived from the driver tables.

The benchmark tables hold invented multilingual prose (``documents``) with
quality/toxicity ``labels``; this module turns them into the raw review
records the extraction step would produce from crawled pages, so every
operator downstream runs on data that grows with the tables.  The same
derivation is written in SQL in ``recensio.plans.sql_text`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEWS_PER_PAGE = 20  # about 20 reviews per listing page
COMPANIES = 24  # the reviews are dealt to so many companies


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than the session has cores
    (one file with one row group cannot be split by Parquet).  A large input
    has more splits and is left alone.  Only the speed of the map-only steps
    depends on it, no result does."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def raw_reviews_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review records (before the >= 50 chars filter and cleaning).

    Columns: company, seq, pagina, pos, page_url, review_id, rating_attr,
    rating_div, testo.  ``seq`` orders a company's reviews as the crawl would
    (page, then position) and starts anew in every company; exact copies of a text share an id, some reviews have none,
    and Italian date/rating phrases are mixed into the text.
    """
    # Text cleaning is the heavy per-row work: give it every task slot.
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    did = F.col("doc_id")
    prefix = (
        F.when(did % 5 == 0, F.lit("Valutato 4 stelle su 5 Pubblicata il 12 marzo 2024 "))
        .when(did % 5 == 1, F.lit("Recensione verificata del 3 maggio 2023: "))
        .when(did % 5 == 2, F.lit("2 stelle. "))
        .when(did % 25 == 3, F.lit("0 stelle. "))
        .otherwise(F.lit(""))
    )
    suffix = F.when(did % 7 == 0, F.lit("\nData dell'esperienza: 1 aprile 2024")).otherwise(F.lit(""))
    rating_attr = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("5"))
        .when(F.col("quality") == 1, F.lit("3"))
        .when(F.col("toxic") == 0, F.lit("2"))
        .when(F.col("toxic") == 1, F.lit("1"))
    )
    company = F.concat(F.lit("c"), (did % COMPANIES).cast("string"))
    nth = F.floor(did / COMPANIES)
    pagina = (F.floor(nth / REVIEWS_PER_PAGE) + 1).cast("int")
    return j.select(
        company.alias("company"),
        nth.alias("seq"),
        pagina.alias("pagina"),
        (nth % REVIEWS_PER_PAGE).cast("int").alias("pos"),
        F.concat(F.lit("https://reviews.example/review/"), company, F.lit("?page="), pagina.cast("string")).alias("page_url"),
        F.when(did % 97 == 0, F.lit(None).cast("string")).otherwise(F.md5("text")).alias("review_id"),
        rating_attr.alias("rating_attr"),
        F.lit(None).cast("string").alias("rating_div"),
        F.concat(prefix, F.col("text"), suffix).alias("testo"),
    )


# --- Fixed values: theme list used by the oracle-checked theme queries. ------
# (tipo, theme_pos, punto): each row exercises one matching rule.
FIXED_THEMES = (
    ("punti_forza", 0, "that with this"),
    ("punti_forza", 1, "from tion"),
    ("punti_forza", 2, "than"),
    ("punti_forza", 3, "zzzz qqqq"),
    ("punti_forza", 4, "a of"),
    ("punti_debolezza", 0, "with from"),
    ("punti_debolezza", 1, "that, this"),
    ("punti_debolezza", 2, "tion"),
)
# -----------------------------------------------------------------------------


def fixed_themes(spark: SparkSession, companies: int = COMPANIES) -> DataFrame:
    """The fixed themes for every company: a literal table."""
    rows = [(f"c{c}", *t) for c in range(companies) for t in FIXED_THEMES]
    return spark.createDataFrame(rows, "company string, tipo string, theme_pos int, punto string")


def responses_from_blocks(blocks: DataFrame) -> DataFrame:
    """Model answers derived from the text blocks, as the answer table
    ``responses(company, block_id, attempt, content)`` the merge step reads.

    Each list category holds up to five two-word items taken from places
    spread over the whole block (so items repeat across blocks and match
    reviews); some answers are
    fenced, some first attempts are broken, some blocks never get a valid
    answer, one keyword is blacklisted and some lists or counts are missing; company
    c5 has no suggestion in one channel.
    """
    from recensio.config import INSIGHT_CATEGORIES

    from recensio.operators.reviews import company_of

    by = company_of(blocks)
    b = F.col("block_id")
    n_items = 5 * len(INSIGHT_CATEGORIES)
    # Item j is the word pair at position floor(j * n / n_items) of the
    # block's n words, so the items are drawn from the whole block.  The
    # block is split once, in its own projection.
    blocks = blocks.select(*by, "block_id", F.split("testo", " ").alias("words"))
    words = F.col("words")

    def at(j):
        return F.floor(j * F.size(words) / n_items).cast("int")

    def items(ci: int):
        arr = F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.concat_ws(" ", F.get(words, at(i + ci * 5)), F.get(words, at(i + ci * 5) + 1)),
        )
        return F.filter(arr, lambda x: x != "")

    fields = []
    for ci, c in enumerate(INSIGHT_CATEGORIES):
        it = items(ci)
        if c == "parole_chiave":
            it = F.when(b % 2 == 0, F.concat(F.array(F.lit("Offerte Maggio")), it)).otherwise(it)
        if c == "leve_marketing":
            it = F.when(b % 6 != 5, it)
        if c == "suggerimenti_cro" and by:
            it = F.when(F.col("company") != "c5", it)
        fields.append(it.alias(c))
    sc = F.struct(
        (b % 7 + 1).alias("positivo"),
        F.when(b % 4 != 1, b % 3).alias("neutro"),
        (b % 2).alias("negativo"),
    )
    blocks = blocks.select(*by, "block_id", F.to_json(F.struct(*fields, sc.alias("sentiment_counts"))).alias("js"))
    js = F.col("js")
    shown = F.when(b % 2 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    att = lambda n, c: F.struct(F.lit(n).alias("attempt"), c.alias("content"))
    trailing = F.concat(js, F.lit(" trailing"))
    tries = (
        F.when(b % 5 == 4, F.array(att(1, trailing), att(2, trailing), att(3, trailing)))
        .when(b % 3 == 0, F.array(att(1, F.lit("{bad")), att(2, shown)))
        .otherwise(F.array(att(1, shown)))
    )
    return blocks.select(*by, "block_id", F.explode(tries).alias("t")).select(
        *by, "block_id", F.col("t.attempt").cast("int").alias("attempt"), F.col("t.content").alias("content")
    )

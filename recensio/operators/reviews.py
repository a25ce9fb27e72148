"""From raw review records to the ``reviews`` table (length filter, rating,
id, link, date, cleaned words), plus the side table of rejected records.

Raw records carry: company, seq, pagina, pos, page_url, review_id,
rating_attr, rating_div, testo.  ``rating_attr`` is the container's own
rating attribute ('' or NULL when absent), ``rating_div`` the attribute of
the first nested element that has one (NULL when there is none).
Everything here is a projection or a filter: map-only, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.functions import text as T

REVIEW_COLUMNS = (
    "company", "seq", "pagina", "pos", "review_id", "testo", "testo_pulito",
    "parole", "rating", "data", "link",
)


def company_of(df: DataFrame) -> list[str]:
    """The grouping columns of a table: an analysis covers one company, a
    table may hold many.  A table without the column is one company."""
    return ["company"] if "company" in df.columns else []


def review_key(df: DataFrame) -> list[str]:
    """What names a review: its place in its company's review order."""
    return [*company_of(df), "seq"]


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def min_length(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Drop records whose text is empty or shorter than ``cfg.min_text_len``."""
    return raw.filter(F.length("testo") >= cfg.min_text_len)


def resolve_rating(rating_attr: Column, rating_div: Column, testo: Column) -> Column:
    """The container attribute if non-empty, else the nested element's
    attribute if such an element exists, else the rating read from the text."""
    return (
        F.when(_nonempty(rating_attr), rating_attr.try_cast("int"))
        .when(rating_div.isNotNull(), rating_div.try_cast("int"))
        .otherwise(T.rating_from_text(testo))
    )


def reject_reason(rating_attr: Column, rating_div: Column) -> Column:
    """Why a record is dropped (a rating attribute that is not an integer),
    or NULL when it is kept."""
    return (
        F.when(_nonempty(rating_attr) & rating_attr.try_cast("int").isNull(),
               F.lit("rating attribute is not an integer"))
        .when(~_nonempty(rating_attr) & rating_div.isNotNull() & rating_div.try_cast("int").isNull(),
              F.lit("nested rating attribute is not an integer"))
    )


def review_link(review_id: Column, page_url: Column, link_base: str) -> Column:
    """Direct link to the review when it has an id, else the page URL."""
    return F.when(_nonempty(review_id), F.concat(F.lit(link_base), review_id)).otherwise(page_url)


def to_reviews(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The reviews table: one row per kept record, with cleaned words."""
    kept = min_length(raw, cfg).filter(
        reject_reason(F.col("rating_attr"), F.col("rating_div")).isNull()
    )
    words = T.clean_words(F.col("testo"), cfg.stopwords, cfg.months)
    return (
        kept.select(
            "company", "seq", "pagina", "pos", "review_id", "testo",
            resolve_rating(F.col("rating_attr"), F.col("rating_div"), F.col("testo")).alias("rating"),
            T.date_text(F.col("testo"), cfg.months).alias("data"),
            review_link(F.col("review_id"), F.col("page_url"), cfg.link_base).alias("link"),
            words.alias("parole"),
        )
        .withColumn("testo_pulito", F.array_join("parole", " "))
        .select(*REVIEW_COLUMNS)
    )


def rejected(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Records long enough to be kept but dropped for a malformed rating, and
    pages and containers that could not be read."""
    reason = F.when(F.length("testo") >= cfg.min_text_len, reject_reason(F.col("rating_attr"), F.col("rating_div")))
    if "error" in raw.columns:
        reason = F.coalesce(F.col("error"), reason)
    return (
        raw.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("company", "seq", "pagina", "pos", "rating_attr", "rating_div", "reason")
    )


def with_identity(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds ``ident``, the key that de-duplicates examples and counts."""
    return reviews.withColumn("ident", T.identity(F.col("review_id"), F.col("testo"), cfg.identity))

"""Merging model answers into one ordered, de-duplicated result.

Input: ``responses(company, block_id, attempt, content)``, the raw answer text of up
to ``max_attempts`` tries per block.  Per block the first attempt whose
text (without code fences) is valid JSON is used.  Each list category is
merged over blocks in (block, place-in-list) order, first occurrence wins;
keywords containing a blacklisted term are dropped; sentiment counts are
summed.  Output long table ``insights(company, categoria, pos, elemento)``;
everything is merged within a company.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from recensio.config import Config, INSIGHT_CATEGORIES, SENTIMENT_CLASSES
from recensio.functions.jsonfn import is_valid_json, strip_fences
from recensio.operators.ordering import running_offset
from recensio.operators.reviews import company_of

ANSWER_SCHEMA = StructType(
    [StructField(c, ArrayType(StringType())) for c in INSIGHT_CATEGORIES]
    + [StructField("sentiment_counts", StructType([StructField(s, LongType()) for s in SENTIMENT_CLASSES]))]
)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(block_id, attempt, valid, answer struct)."""
    from recensio.session import ship_package

    ship_package(responses.sparkSession)
    cleaned = responses.withColumn("cleaned", strip_fences(F.col("content")))
    valid = is_valid_json(F.col("cleaned"))
    answer = F.when(valid, F.from_json("cleaned", ANSWER_SCHEMA))
    return cleaned.select(*company_of(responses), "block_id", "attempt", valid.alias("valid"), answer.alias("answer"))


def first_valid(parsed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(block_id, attempt, answer): the first valid attempt of each block
    (a partial aggregate, no sort of the answers)."""
    ok = parsed.filter(F.col("valid") & (F.col("attempt") <= cfg.max_attempts))
    by = company_of(parsed)
    first = ok.groupBy(*by, "block_id").agg(F.min_by(F.struct("attempt", "answer"), "attempt").alias("f"))
    return first.select(*by, "block_id", "f.attempt", "f.answer")


def insight_items(answers: DataFrame) -> DataFrame:
    """(block_id, categoria, item_pos, elemento) in long form; a category
    that is missing or not a list counts as empty."""
    cats = F.array(*[F.struct(F.lit(c).alias("categoria"), F.col("answer")[c].alias("items")) for c in INSIGHT_CATEGORIES])
    by = company_of(answers)
    per_cat = answers.select(*by, "block_id", F.explode(cats).alias("c")).select(*by, "block_id", "c.categoria", "c.items")
    return per_cat.select(*by, "block_id", "categoria", F.posexplode("items").alias("item_pos", "elemento")).filter(
        F.col("elemento").isNotNull()
    )


def keyword_allowed(elemento, blacklist) -> "F.Column":
    low = F.lower(elemento)
    return ~F.exists(F.array(*[F.lit(t) for t in blacklist]), lambda t: F.instr(low, t) > 0)


def merge_insights(answers: DataFrame, cfg: Config = Config(), blacklist: bool = True) -> DataFrame:
    """(company, categoria, pos, elemento): ordered distinct union per category."""
    items, by = insight_items(answers), company_of(answers)
    firsts = items.groupBy(*by, "categoria", "elemento").agg(F.min(F.struct("block_id", "item_pos")).alias("f"))
    if blacklist:
        firsts = firsts.filter((F.col("categoria") != "parole_chiave") | keyword_allowed(F.col("elemento"), cfg.keyword_blacklist))
    firsts = firsts.select(*by, "categoria", "elemento", F.col("f.block_id").alias("block_id"), F.col("f.item_pos").alias("item_pos"))
    ranked = running_offset(firsts, order=["block_id", "item_pos"], weight=F.lit(1), partition=[*by, "categoria"], out="pos")
    return ranked.select(*by, "categoria", F.col("pos").cast("long").alias("pos"), "elemento")


def sentiment_distribution(answers: DataFrame) -> DataFrame:
    """(company, positivo, neutro, negativo): sums over used answers."""
    sc = F.col("answer.sentiment_counts")
    return answers.groupBy(*company_of(answers)).agg(*[F.coalesce(F.sum(F.coalesce(sc[s], F.lit(0))), F.lit(0)).cast("long").alias(s) for s in SENTIMENT_CLASSES])


def sentiment_share(dist: DataFrame) -> DataFrame:
    """Shares in percent; no row when there is no positive count."""
    total = sum(F.col(s) for s in SENTIMENT_CLASSES)
    return dist.filter(F.col("positivo") > 0).select(
        *company_of(dist), *[F.when(total > 0, F.col(s) / total * 100).otherwise(F.lit(0.0)).alias(f"{s}_pct") for s in SENTIMENT_CLASSES]
    )

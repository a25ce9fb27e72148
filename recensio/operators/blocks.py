"""Fixed-size word blocks of each company's corpus (the model's input).

All cleaned texts of a company in review order form one word stream, cut every
``block_words`` words (blocks cross review borders, the last one is
short).  The corpus is never assembled: each review learns its global word
offset from a running sum over (key, word count) rows, emits one slice per block it touches,
and each block gathers at most ``block_words`` words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators.ordering import running_offset
from recensio.operators.reviews import company_of, review_key
from recensio.session import materialize, stored

# Our own request wording; the block text goes between head and tail.
PROMPT_HEAD = (
    "Read the customer reviews below and answer with one JSON object with the keys "
    "punti_forza, punti_debolezza, leve_marketing, parole_chiave, suggerimenti_seo, "
    "suggerimenti_adv, suggerimenti_email, suggerimenti_cro, suggerimenti_sinergie "
    "(lists of strings) and sentiment_counts (positivo, neutro, negativo).\n\nREVIEWS:\n"
)
PROMPT_TAIL = "\n\nIgnore dates, months, weekdays and the word 'verificata'."


def word_offsets(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(company, seq, n_words, offset): the position of each review's first
    word in its company's word stream."""
    # Written first: dealing by range looks at its input twice.
    r = materialize(reviews.select(*review_key(reviews), F.size("parole").alias("n_words")))
    return running_offset(r, order=["seq"], weight=F.col("n_words"), partition=company_of(reviews))


def text_blocks(reviews: DataFrame, cfg: Config = Config(), written: bool = False) -> DataFrame:
    """(company, block_id, n_words, testo); blocks are numbered per company.
    written: ``reviews`` is a written table, reading it again costs little."""
    n, by, key = cfg.block_words, company_of(reviews), review_key(reviews)
    # Read twice (offsets, then slices): cleaned once.
    words = reviews.select(*key, "parole")
    words = words if written else stored(words)
    # The words meet their offsets only now: none pass through the window.
    o = word_offsets(words, cfg).filter(F.col("n_words") > 0).join(moved_words(words, key), key)
    first = F.floor(F.col("offset") / n)
    last = F.floor((F.col("offset") + F.col("n_words") - 1) / n)
    pieces = o.select(*key, "offset", "n_words", "text", "parole", F.explode(F.sequence(first, last)).alias("block_id"))
    start = F.greatest(F.col("offset"), F.col("block_id") * n) - F.col("offset")
    end = F.least(F.col("offset") + F.col("n_words"), (F.col("block_id") + 1) * n) - F.col("offset")
    cut = F.slice(F.coalesce("parole", F.split("text", " ")), start + 1, end - start)
    # a piece of nulls has no text
    part = F.when(F.size(F.array_compact(cut)) > 0, F.array_join(cut, " "))
    pieces = pieces.select(
        *by, "block_id", "seq", (end - start).alias("k"), F.when(F.col("parole").isNull() & (end - start == F.col("n_words")), F.col("text")).otherwise(part).alias("piece")
    )
    grouped = pieces.groupBy(*by, "block_id").agg(
        F.sum("k").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("ps"),
    )
    return grouped.select(
        *by, F.col("block_id").cast("long").alias("block_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.array_join(F.transform("ps", lambda p: p["piece"]), " ").alias("testo"),
    )


def moved_words(words: DataFrame, key: list[str]) -> DataFrame:
    """(*key, text, parole): the words as one text; a text that its spaces do
    not part into the same words keeps the array, the others have none."""
    # A null would stand as two spaces: a text of as many spaces as lie between its words has none.
    text = F.array_join("parole", " ", "  ")
    plain = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1 == F.size("parole")
    return words.select(*key, F.when(plain, text).otherwise(F.array_join("parole", " ")).alias("text"), F.when(~plain, F.col("parole")).alias("parole"))


def block_count(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per company: total words and number of blocks."""
    total = F.coalesce(F.sum(F.size("parole")), F.lit(0)).cast("long")
    by = company_of(reviews)
    return reviews.groupBy(*by).agg(total.alias("n_words")).select(
        *by, "n_words", F.ceil(F.col("n_words") / cfg.block_words).cast("long").alias("n_blocks")
    )


def prompts(blocks: DataFrame, head: str = PROMPT_HEAD, tail: str = PROMPT_TAIL) -> DataFrame:
    """(company, block_id, prompt): the request text for each block."""
    return blocks.select(*company_of(blocks), "block_id", F.concat(F.lit(head), F.col("testo"), F.lit(tail)).alias("prompt"))

"""The corpus pipeline: quality rules, SimHash near-duplicates, repeated
substrings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result as
Parquet in the session's shared folder and reads it again as the next one's
input, so a stage is computed once and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recensio.llm.common import shared_folder, table
from recensio.llm.packing import packed_pieces
from recensio.llm.pii import key_of, pseudonymise
from recensio.llm.quality import fit_quality, quality_rules
from recensio.llm.simhash import one_of_each
from recensio.llm.suffix import remove_repeats


def _with_text(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """rows(row struct, ...) as the columns of ``docs`` with a new text and
    its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return one_of_each(docs).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings.  A character cut
    apart goes whole; a text of which nothing is left stays as an empty one, a
    null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    none = "_" + "_".join(docs.columns)  # no column's name
    held = docs.withColumn(none, F.col("text").isNull())
    rows = remove_repeats(held, carry=(*others, none), as_text=True).withColumnRenamed("rest", "row")
    return _with_text(rows, docs, F.when(~F.col(f"row.`{none}`"), F.col("kept")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return _with_text(pseudonymise(docs, key_of(spark)), docs, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packed_pieces(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("PII surrogates", personal_data),
    ("best-fit packing", packing),
]

#: Fingerprints, trees and tokens are beyond SQL; tests hold the stages
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_folder(spark, f"stage{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

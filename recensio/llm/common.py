"""Helpers the operators share: table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recensio.session import ensure_checkpoint_dir, ship_package

MASK64 = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as (doc_id, text): other
    columns, whatever their names, never meet the operator's own.  A null
    text becomes the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt and sorted by columns and written as a checkpoint whose
    layout Spark knows: joins on these columns do not move it again.  Adaptive
    planning is off for this one write, as it would hide the layout."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(*by).sortWithinPartitions(*by).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written as Parquet in the shared folder, which take a fraction
    of a checkpoint's room, until ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables; nothing that is still to run may read them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers (local sessions)."""
    ship_package(spark)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so what a worker builds for a batch
    stays small however many rows Arrow sends at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def list_array(parts: list[np.ndarray], dtype) -> pa.ListArray:
    """Arrow list column from one numpy array per row."""
    lens = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(lens, out=off[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(dtype, copy=False)))

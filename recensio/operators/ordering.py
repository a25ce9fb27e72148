"""Global running sums without a global window.

``running_offset`` gives every row the sum of a weight over all rows before
it in a total order (e.g. the word offset of a review in its company's word
stream, or the rank of an element).  Rows are range-partitioned in that
order, so every partition holds about the same number of rows whatever the
key values are; a window per partition gives the local sum, and only the
partition totals are summed in order, one row per (group, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recensio.session import materialize


def running_offset(df: DataFrame, order: list, weight: Column, partition: list[str] | None = None, out: str = "offset") -> DataFrame:
    """Adds ``out`` = sum of ``weight`` over rows strictly before each row.

    ``order`` sorts rows within a group and must be unique there;
    ``partition`` names the group columns (the sum restarts per group).
    ``df`` should be narrow: it is range-partitioned and written once, so
    that the partition numbers its sums rest on cannot change.
    """
    part = list(partition or [])
    rows = df.withColumn("_w", weight).repartitionByRange(*part, *order)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*part, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    totals = rows.groupBy(*part, "_part").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*part).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return (
        local.join(bases, [*part, "_part"])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop("_part", "_w", "_base", "_local")
    )

"""Prefix sums over a whole table without one task that holds it: range partitions, their totals, and a window inside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import parallelism, stored


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``_before`` (sum of ``value`` over the rows of its group that sort before it) and ``_index`` (their count).

    The rows are dealt out by range of (group, order) and written once, so that the partition numbers hold whatever is
    lost later. Only the totals of the partitions meet: one row for each partition and group. A group of any size, and
    any number of rows that tie, spreads over partitions; rows that tie in every column are interchangeable.
    ``group`` columns must not be null; an empty table gives an empty table.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parallelism(df.sparkSession), *group, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "prefix")
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy(*group, "_part")
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row0"))
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order, "_tie")
    sofar = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(totals, [*group, "_part"])
        .withColumn("_before", F.col("_sum0") + F.coalesce(F.sum(value).over(sofar), F.lit(0)))
        .withColumn("_index", F.col("_row0") + F.row_number().over(inside) - 1)
        .drop("_sum0", "_row0", "_part", "_tie")
    )

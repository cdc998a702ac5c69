"""Running numbers over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """`rows` with their number from 0 on by `order`: rows are numbered within ranges of the order, after the rows of the ranges before.

    The ranges are a table, so that a range that is computed again after a lost executor has the same rows.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_own") - 1 + F.col("_offset")).drop("_range", "_own", "_offset")

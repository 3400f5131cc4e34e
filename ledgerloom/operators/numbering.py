"""Running numbers over a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import durable


def number_rows(df: DataFrame, order: list[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """df with 1, 2, 3 ... in the given order (nulls first). Rows are range-partitioned and numbered within their
    partition; each partition's offset is the sum of the counts before it, one row per partition."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn("own", own).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("own") + F.col("before")).cast("bigint")).drop("own", "before", "__part")


def unique_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Repeated rows dropped; a repeated id gets -2, -3 ... in order."""
    d = df.dropDuplicates()
    n = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return d.withColumn("__n", n).withColumn(column, F.when(F.col("__n") == 1, F.col(column)).otherwise(F.concat(column, F.lit("-"), F.col("__n").cast("string")))).drop("__n")

"""Consecutive numbers in a total order, without one task holding all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.session import settled


def numbered(df: DataFrame, order: Sequence[str], column: str, first: int = 0) -> DataFrame:
    """Adds the position in ``order``: rows are range-partitioned, numbered inside a partition, and shifted by the sizes of the partitions before."""
    d = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    d = settled(df.sparkSession, d, "ranged")  # the partition ids are now data
    inner = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    sizes = d.groupBy("part_").count()
    before = sizes.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))  # one row a partition
    return d.withColumn("k_", inner).join(F.broadcast(before), "part_").withColumn(column, (F.col("before_") + F.col("k_") - 1 + first).cast("long")).drop("part_", "k_", "before_")

"""Places and running sums in the order of all rows, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Ranges where the session names no width of shuffles.
RANGES = "200"


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before each one in the order, which must tell all rows apart.

    Spark cuts the order into ranges by a sample, and the ranges are written to the shared folder, so that
    a lost task moves no border. Sums inside a range are a window of its own; only one sum
    for each range goes through one task.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", RANGES))
    path = scratch(spark, "ranges")
    df.repartitionByRange(ranges, *order).withColumns({"__range": F.spark_partition_id(), "__value": value}).write.parquet(path)
    cut = spark.read.parquet(path)
    sums = cut.groupBy("__range").agg(F.sum("__value").alias("__all"))
    before = sums.select("__range", (F.sum("__all").over(Window.orderBy("__range")) - F.col("__all")).alias("__before"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__value")
    rows = cut.withColumn("__inside", inside).join(F.broadcast(before), "__range")
    return rows.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))

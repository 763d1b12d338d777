"""Running totals over a whole table in some order, without a window that one task computes.

Rows are dealt by ranges of the order (Spark samples the splitters), so equal
rows stay together and every task has about as many; ranges are written with
their number, their totals are added up, one row each, and the rest is a window
within each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import fresh_path


def running(rows: DataFrame, order: Column | str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the total of ``value`` (whole numbers) over all rows up to this one in ``order``; rows that tie get that of the last of them.

    ``order`` is a column or a direction of one (``F.desc("x")``); nulls stand
    where that puts them. An empty table stays empty.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "ranges")
    order = F.asc(order) if isinstance(order, str) else order
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    totals = held.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # One row for each range: as many as there are shuffle partitions.
    before = totals.select("_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(order))
    return held.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")

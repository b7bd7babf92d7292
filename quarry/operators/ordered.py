"""Running sums over long orders, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.tables import staged


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same keys that come before in `order` (which must tell rows apart).

    Rows are dealt out by ranges of the order; each range sums its own rows, and the few sums of the ranges are added up before. The ranges are written, so that both passes
    see the same ones: a job runs while the result is built."""
    d = staged(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = d.groupBy(*keys, "_range").agg(F.sum(value).alias("_own"))
    earlier = F.coalesce(F.sum("_own").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_range", earlier.alias("_earlier"))
    within = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_within", within).join(sums, [*keys, "_range"]).withColumn(name, F.col("_earlier") + F.col("_within")).drop("_earlier", "_within", "_range")

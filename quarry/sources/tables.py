"""Reading and writing tables: Parquet, JDBC, process-sample CSV, exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import SAMPLES


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A database table read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)


def write_snapshots(df: DataFrame, path: str) -> None:
    """Replaces only the snapshots that df holds."""
    df.write.partitionBy("snapshot_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).csv(path)


def export_json(df: DataFrame) -> DataFrame:
    """One JSON line per row, in a column `value` that write.text takes."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def staged(df: DataFrame) -> DataFrame:
    """df written below the shared checkpoint folder and read back: the steps of an iteration neither repeat earlier work nor carry its plan,
    and survive the loss of executors. A local folder serves only on one machine without a folder set."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    path = f"{base}/steps-{context.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

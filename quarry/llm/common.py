"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Word shingle length and similarity of the near-duplicate operators.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


#: Most rows and bytes of a batch that goes to a Python worker: texts and their word hashes are long, and a batch exists several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's batch limits to BATCH where they are higher or unset. They stay so: plans read them when they run."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, str(most + 1))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """A new path of this application below the shared checkpoint folder; a local one only where none is set on one machine (tests)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/corpus-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written by `cut`. Call it once the results that read from there are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark).rpartition("/")[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver let go of what past steps have left there: their plans, broadcasts and shuffle files stay until its garbage is collected,
    and meanwhile its heap grows with every query."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to shared storage and read it back: later steps neither repeat the work nor depend on an executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(*cols: Column) -> Column:
    """A fixed number in [0, 1) from the values: 52 bits of their MD5."""
    key = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def longs(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of long arrays, as views of one buffer; null is empty."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.diff(column.offsets.to_numpy())])
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends)) if column.null_count else np.diff(ends)
    ends = np.cumsum([0, *sizes])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def with_python(df: DataFrame, keep: Sequence[Column], read: Sequence[Column], new: str, compute: Callable) -> DataFrame:
    """Columns k0, k1, ... (those in `keep`) and the columns `new` (DDL), computed batch by batch from `read`.

    The kept columns pass through as Arrow data: Python never turns them into numbers of its own, so a large integer beside a null
    stays what it is. `compute(*columns)` takes Arrow arrays and returns (rows, columns): the positions in the batch that the
    results belong to, or None for one result a row, and a list for each new column. All names are this function's own, so
    the caller's columns cannot clash with them."""
    src = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], *[c.alias(f"r{i}") for i, c in enumerate(read)])
    n, added = len(keep), StructType.fromDDL(new) if new else StructType()
    schema = StructType([*[StructField(f.name, f.dataType) for f in src.schema.fields[:n]], *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, columns = compute(*b.columns[n:])
            kept = b.columns[:n] if rows is None else [c.take(pa.array(rows, pa.int64())) for c in b.columns[:n]]
            made = [c if isinstance(c, pa.Array) and c.type == t else pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return src.mapInArrow(run, schema)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, also such with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def renamed(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The kept columns k0, k1, ... under the names that they have in `like`, and more."""
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(like.columns)], *more)

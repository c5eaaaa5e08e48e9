"""What the operators share on Spark's side."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch

#: A batch of an Arrow function, in rows and in bytes; bounds the memory of a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's own one, under that which all executors share;
    it goes when the driver ends."""
    return scratch.folder(spark)


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage and compute once: a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that no frame reads any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table._kept
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fewer(df: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Join splits that are small, by the size of the input as the plan knows it.

    A task costs a fixed time, so thousands of small files need not be as many
    tasks; splits of ``split_bytes`` and more stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // split_bytes)), 2**31 - 1))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that are no longer used; it does
    so only when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_stockweave_shipped", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stockweave-")) / "stockweave_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._stockweave_shipped = True


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for a worker's memory."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key as text, modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % by


def held_out(key: Column, by: int, rest: int) -> Column:
    """Whether a row is held out of training; a row without key never is."""
    return F.coalesce(remainder(key, by) == rest, F.lit(False))


def tree_sum(df: DataFrame, key: str, value: str, dtype: str, fan: int = 256) -> dict[int, np.ndarray]:
    """Sum the arrays in the binary column ``value`` by ``key``, to the driver.

    For a number of keys and array sizes fixed by a parameter.  A task adds up to
    about ``fan`` arrays of a key, in as many rounds as the number of arrays needs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(v, dtype)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.copy()
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    ship(df.sparkSession)
    pair = df.select(F.col(key).cast("long").alias("k"), F.col(value).alias("v"))
    while True:
        arrays = pair.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if arrays <= fan:
            break
        shards = -(-arrays // fan)
        dealt = pair.withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).repartition(16 * shards, "k", "s").select("k", "v")
        pair = keep(dealt.mapInArrow(add, "k long, v binary"))
    out: dict[int, np.ndarray] = {}
    for row in pair.repartition(16, "k").mapInArrow(add, "k long, v binary").toLocalIterator():
        out[row.k] = np.frombuffer(row.v, dtype)
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

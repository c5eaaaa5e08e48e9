"""Intermediate tables in the folder that all executors share.

That is ``spark.checkpoint.dir``; where a local session has none, as in tests, a folder of
this machine is set.  All of a session's tables go when its driver ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='stockweave-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the session's own folder; nothing is there yet."""
    context = spark.sparkContext
    own = getattr(context, "_stockweave_folder", None)
    if own is None:
        own = context._stockweave_folder = f"{_base(spark)}/stockweave-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute once: the rows as a table that later steps read."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

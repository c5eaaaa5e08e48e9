"""Updates as a stream: the latest change of each id, merged batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str = "doc_id", order: str = "event_id") -> DataFrame:
    """The last change of each key; combined before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("c")).select(key, "c.*")


class Table:
    """The table a stream keeps up to date: a base and the changes of batches since.

    A batch writes its own changes only; every ``compact_every`` batches base and
    changes become a new base without deleted rows, and older folders go.  A batch
    that is run again writes the same folder, so the result doesn't depend on
    retries; of an id's changes the latest counts, so neither on order.  All state is
    in the folder, so a restart goes on from it.  Deletions are kept in a base for
    one compaction, so that a change that comes late doesn't bring a row back."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, batch: int, kind: str = "batch") -> str:
        return f"{self.root}/{kind}={batch}"

    def _numbers(self, kind: str) -> list[int]:
        """Folders that were written to their end."""
        if not self.fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in found if self.fs.exists(self._path(f"{self.folder(n, kind)}/_SUCCESS")))

    def _state(self, upto: int | None = None) -> DataFrame | None:
        """The last change of each id; ``upto`` leaves later folders out."""
        bases = [n for n in self._numbers("base") if upto is None or n <= upto]
        batches = [n for n in self._numbers("batch") if (upto is None or n <= upto) and (not bases or n > bases[-1])]
        parts = [self.spark.read.parquet(self.folder(n, "batch")) for n in batches]
        if bases:
            parts.insert(0, self.spark.read.parquet(self.folder(bases[-1], "base")))
        return latest(reduce(DataFrame.unionByName, parts)) if parts else None

    def merge(self, changes: DataFrame, batch: int) -> None:
        latest(changes).write.mode("overwrite").parquet(self.folder(batch))
        if batch % self.compact_every == self.compact_every - 1:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        bases = self._numbers("base")
        state = self._state(batch)
        if bases and bases[-1] < batch:  # what the base before has as deleted goes now
            old = self.spark.read.parquet(self.folder(bases[-1], "base")).filter("op = 'delete'").select("doc_id", "event_id")
            state = state.join(old, ["doc_id", "event_id"], "left_anti")
        state.write.mode("overwrite").parquet(self.folder(batch, "base"))
        for kind, keep in (("batch", batch), ("base", bases[-1] if bases else batch)):
            for n in self._numbers(kind):
                if n < keep:
                    self.fs.delete(self._path(self.folder(n, kind)), True)

    def read(self) -> DataFrame:
        """Live rows: the last change was no delete."""
        state = self._state()
        if state is None:
            raise LookupError("nothing was merged yet")
        return state.filter("op <> 'delete'")


def upsert_stream(source: DataFrame, table: Table, checkpoint: str, interval: str | None = None):
    """Start the stream; without an interval it takes what is there and ends."""
    writer = source.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def replay(source: DataFrame, root: str) -> DataFrame:
    """Run a stream of ``(event_id, doc_id, op, value)`` to its end: the live rows."""
    table = Table(source.sparkSession, f"{root}/table")
    upsert_stream(source, table, f"{root}/checkpoint").awaitTermination()
    return table.read().select("doc_id", "value")

"""Versioned tables: sessions, bulk adds, deployment, upserts, clean-up.

A table ``name`` is a folder with ``v=<n>`` folders of Parquet and a pointer file
that names the live one.  All access goes through Hadoop's file system, so it
works on any store Spark reads.  Writers that start at one time get versions of their
own: a version is claimed by a file that only one of them can create."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result codes of updates.
CREATED, UPDATED, DELETED, NOT_FOUND, NOOP, DISMISSED = "CREATED", "UPDATED", "DELETED", "NOT_FOUND", "NOOP", "DISMISSED"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def versions(self, name: str) -> list[int]:
        top = f"{self.root}/{name}"
        if not self._exists(top):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(top))]
        return sorted(int(x[2:]) for x in found if x.startswith("v="))

    def start(self, name: str, locale: str) -> tuple[str, int]:
        """A session: the next version of ``name-locale``."""
        if name != name.lower():
            raise ValueError("names are lower case")
        full = f"{name}-{locale.lower()}"
        n = max(self.versions(full), default=0) + 1
        while not self._claim(full, n):
            n += 1
        self.fs.mkdirs(self._path(f"{self.root}/{full}/v={n}"))
        return full, n

    def _claim(self, full: str, n: int) -> bool:
        """Whether this writer is the one who gets version ``n``: a file that only one can create."""
        folder = self._path(f"{self.root}/{full}/_claims")
        self.fs.mkdirs(folder)
        path = self._path(f"{self.root}/{full}/_claims/{n}")
        jvm = self.spark.sparkContext._jvm
        try:
            if self.fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
                return jvm.java.io.File(path.toUri().getPath()).createNewFile()
            self.fs.create(path, False).close()
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def folder(self, session: tuple[str, int]) -> str:
        return f"{self.root}/{session[0]}/v={session[1]}"

    def add(self, session: tuple[str, int], docs: DataFrame) -> None:
        docs.write.mode("append").parquet(self.folder(session))

    def live(self, name: str) -> int | None:
        pointer = f"{self.root}/{name}/_live"
        if not self._exists(pointer):
            return None
        stream = self.fs.open(self._path(pointer))
        try:
            return int(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def modified(self, name: str) -> tuple[int, int] | None:
        """When the live version was set, in milliseconds, and which it is."""
        pointer = f"{self.root}/{name}/_live"
        if not self._exists(pointer):
            return None
        return self.fs.getFileStatus(self._path(pointer)).getModificationTime(), self.live(name)

    def deploy(self, session: tuple[str, int], minimum: int = 1) -> bool:
        """Make a version live if it has enough documents.

        The pointer is replaced in one step where the file system can; the version
        before stays for readers that have begun, older ones go."""
        name, n = session
        before = self.live(name)
        if before == n or self.spark.read.parquet(self.folder(session)).count() < minimum:
            return False
        new = self._path(f"{self.root}/{name}/_live.new")
        stream = self.fs.create(new, True)
        stream.write(bytearray(str(n), "utf-8"))
        stream.close()
        pointer = self._path(f"{self.root}/{name}/_live")
        self._replace(new, pointer)
        for v in self.versions(name):
            if before is not None and v < before:
                self.fs.delete(self._path(f"{self.root}/{name}/v={v}"), True)
        return True

    def _replace(self, new, pointer) -> None:
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, pointer, options)

    def cancel(self, session: tuple[str, int]) -> None:
        self.fs.delete(self._path(self.folder(session)), True)

    def read(self, *names: str) -> DataFrame:
        """Live tables together, with ``_index``; a table without a live version is an error."""
        missing = [n for n in names if self.live(n) is None]
        if missing:
            raise LookupError(f"no live version of {', '.join(missing)}")
        frames = [self.spark.read.parquet(f"{self.root}/{n}/v={self.live(n)}").withColumn("_index", F.lit(n)) for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def tenants(self, configured: tuple[str, ...] = (), loaded: tuple[str, ...] = ()) -> list[str]:
        """Tables with a live version, and those that are configured or loaded."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))] if self._exists(self.root) else []
        return sorted({*configured, *loaded, *(n for n in found if self.live(n) is not None)})

    def cleanup(self, older_than_s: int = 6 * 3600) -> list[str]:
        """Versions that aren't live and are old enough go."""
        gone = []
        for s in self.fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            for n in self.versions(name):
                path = self._path(f"{self.root}/{name}/v={n}")
                if n != self.live(name) and time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 >= older_than_s:
                    self.fs.delete(path, True)
                    gone.append(f"{name}/v={n}")
        return gone

    def rewrite(self, name: str, docs: DataFrame) -> None:
        """A new version from a changed table, made live."""
        n = max(self.versions(name), default=0) + 1
        self.add((name, n), docs.drop("_index"))
        self.deploy((name, n), 0)


def put(docs: DataFrame, updates: DataFrame, replace: bool = True) -> DataFrame:
    """Upsert by ``doc_id``; with ``replace=False`` only new ids are added."""
    if replace:
        return docs.join(updates.select("doc_id"), "doc_id", "left_anti").unionByName(updates, allowMissingColumns=True)
    return docs.unionByName(updates.join(docs.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def result_codes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``doc_id, result`` of changes ``(doc_id, op)``, op being put, create, patch or delete."""
    have = docs.select("doc_id", F.lit(True).alias("__have"))
    op, have_it = F.col("op"), F.col("__have").isNotNull()
    code = (
        F.when(op == "delete", F.when(have_it, DELETED).otherwise(NOT_FOUND))
        .when(op == "create", F.when(have_it, NOOP).otherwise(CREATED))
        .when(op == "patch", F.when(have_it, UPDATED).otherwise(NOT_FOUND))
        .when(op == "put", F.when(have_it, UPDATED).otherwise(CREATED))
        .otherwise(DISMISSED)
    )
    return changes.join(have, "doc_id", "left").select("doc_id", code.alias("result"))

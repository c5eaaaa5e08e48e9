"""A stored index of terms, for many queries at once.

Postings are a table ``(shard, row, doc_id, len, term, tf, positions)`` bucketed by shard,
beside a dictionary ``(term, df)`` and the statistics of the field.  A shard holds whole
documents, told by a hash of their ids, and is a bucket of about ``SHARD_ROWS`` postings (at
``DOCUMENT_ROWS`` of a document), so the number of buckets grows with the documents and
what a task holds does not.  Shards have numbers that are hashed to buckets of their own:
buckets of several shards would differ the more, the more of them there are.

They are written once; a batch of queries is then one join on the term in which only
the queries' terms are moved: all postings of a document lie in one shard, so scores are
summed and phrases put together where the postings are.  A batch of up to ``BATCH_ROWS``
terms goes to every task; a larger one is asked for shard by shard.

Scores are BM25, summed as whole millionths: sums then don't depend on the order in
which partitions arrive, and ties are ties.

Documents without a token count for the statistics and are found by nothing.  Null
token arrays are empty.  For scores, repeated ids are documents of their own only if
their rows differ in the number of tokens; a phrase is looked for in each row."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .matching import K1, B

SHARD_ROWS = 1 << 20
DOCUMENT_ROWS = 256
BATCH_ROWS = 1 << 17
MICRO = 1_000_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    dictionary: DataFrame
    documents: int
    average: float
    shards: list[int]
    repeats: bool


def _grouper() -> Callable:
    """A task's documents as postings: positions grouped inside each document, some documents at a time."""

    def grouped(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                lists = batch.column("tokens")
                words = lists.flatten().dictionary_encode(null_encoding="encode")
                length = np.diff(lists.offsets.to_numpy())
                if not len(words):
                    continue
                doc = np.repeat(np.arange(len(length)), length)
                code = words.indices.to_numpy()
                order = np.argsort(doc * len(words.dictionary) + code, kind="stable")
                doc, code = doc[order], code[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
                ends = np.r_[first, len(order)].astype(np.int32)
                places = (order - (np.cumsum(length) - length)[doc]).astype(np.int32)
                own = batch.select(["shard", "row", "doc_id"]).take(pa.array(doc[first]))
                more = [pa.array(length[doc[first]].astype(np.int32)), words.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(places))]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=["shard", "row", "doc_id", "len", "term", "tf", "positions"])

    return grouped


def _numbers(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket, which is hashed to it; should a bucket be left without one, the others take its documents."""
    tried = spark.range(32 * buckets).select(F.col("id").cast("int").alias("n"))
    return sorted(x.n for x in tried.groupBy(F.pmod(F.hash("n"), F.lit(buckets)).alias("bucket")).agg(F.min("n").alias("n")).collect())


def build(docs: DataFrame, tokens: Column, key: str = "doc_id", buckets: int | None = None, shard_rows: int = SHARD_ROWS, folder: str | None = None) -> Index:
    """Write the index of a field to a folder, by default one of the session's own."""
    spark = docs.sparkSession
    folder = folder or scratch.folder(spark, "index")
    # Joins on the shard and more find their rows in one place.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    documents = docs.count()
    repeats = not docs.groupBy(key).count().filter("count > 1").isEmpty()
    buckets = max(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), min(documents, -(-documents * DOCUMENT_ROWS // shard_rows)))
    shards = _numbers(spark, buckets)
    # Documents are moved once, as texts, to the task that keeps their postings; these are not moved.
    placed = docs.withColumn("shard", F.get(F.lit(shards), F.pmod(F.xxhash64(key), F.lit(len(shards))).cast("int"))).repartition(buckets, "shard")
    slim = placed.select("shard", F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    schema = f"shard int, row long, doc_id {docs.select(key).schema[0].dataType.simpleString()}, len int, term string, tf int, positions array<int>"
    name = f"postings_{uuid.uuid4().hex}"
    slim.mapInArrow(_grouper(), schema).write.bucketBy(buckets, "shard").sortBy("term").option("path", f"{folder}/postings").saveAsTable(name)
    postings = spark.table(name)
    said = postings.select("term", "doc_id", "len", "tf")
    if repeats:
        said = said.groupBy("term", "doc_id", "len").agg(F.sum("tf").alias("tf"))
    words = said.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    words.write.parquet(f"{folder}/dictionary")
    words = spark.read.schema(words.schema).parquet(f"{folder}/dictionary")
    total = words.agg(F.sum("cf")).first()[0] or 0
    return Index(postings, words.drop("cf"), documents, total / documents if total else 1.0, shards, repeats)


def _met(index: Index, postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the terms asked for, with what is asked; they stay in their shards."""
    spark = asked.sparkSession
    asked = scratch.keep(asked, "asked")
    if not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-") and asked.count() <= BATCH_ROWS:
        return postings.join(F.broadcast(asked), "term")
    return postings.join(asked.withColumn("shard", F.explode(F.lit(index.shards))), ["shard", "term"])


def _half_up(x: Column) -> Column:
    whole = F.floor(F.abs(x))
    up = whole + (F.abs(x) - whole >= 0.5).cast("long")
    return F.when(x < 0, -up).otherwise(up)


def score(index: Index, terms: DataFrame) -> DataFrame:
    """``query, doc_id, score`` (millionths) for terms ``(query, term, weight)``; weights of a term add up."""
    asked = terms.groupBy("query", "term").agg(F.sum("weight").alias("weight")).join(index.dictionary, "term")
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("query", "term", (F.col("weight") * idf).alias("worth"))
    postings = index.postings.select("shard", "term", "doc_id", "len", "tf")
    if index.repeats:
        postings = postings.groupBy("shard", "term", "doc_id", "len").agg(F.sum("tf").alias("tf"))
    part = F.col("worth") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(index.average))))
    sums = _met(index, postings, asked).groupBy("shard", "query", "doc_id").agg(F.sum(_half_up(part * MICRO)).alias("score"))
    return sums.select("query", "doc_id", "score")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of each query, with their ``rank``.

    Tasks keep their own best before the shuffle (a limit of ranks in windows), so
    a query that a third of all documents meet is no large group."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def terms_of(queries: DataFrame, tokens: Column, key: str) -> DataFrame:
    return queries.select(F.col(key).alias("query"), F.explode(tokens).alias("term"), F.lit(1.0).alias("weight"))


def phrases(index: Index, queries: DataFrame, key: str = "query", words: str = "words") -> DataFrame:
    """``query, doc_id, times``: how often each query's words occur in a row.

    A word at place i of the query and p of the document speaks for a phrase that
    begins at p - i.  Each query's rarest word tells where it may begin; only there the
    positions of its other words are looked at."""
    named = scratch.keep(queries.select(F.monotonically_increasing_id().alias("q"), F.col(key).alias("query"), F.col(words).alias("words")), "queries")
    known = named.select("q", "query", F.size("words").alias("n"), F.posexplode("words").alias("i", "term")).join(index.dictionary, "term")
    # Rarest first; a query with a word that no document has is met by none.
    whole = known.groupBy("q", "query", "n").agg(F.sort_array(F.collect_list(F.struct("df", "i", "term"))).alias("words")).filter(F.size("words") == F.col("n"))
    whole = scratch.keep(whole, "words")
    rarest = whole.select("q", "query", "n", F.col("words")[0]["term"].alias("term"), F.col("words")[0]["i"].alias("at"), F.slice("words", F.lit(2), F.size("words") - 1).alias("others"))
    postings = index.postings.select("shard", "term", "row", "doc_id", "positions")
    begins = _met(index, postings, rarest).select("shard", "row", "doc_id", "q", "query", "n", "others", F.transform("positions", lambda p: p - F.col("at")).alias("begins"))
    asked = begins.withColumn("o", F.explode_outer("others")).select("shard", "row", "doc_id", "q", "query", "n", "begins", "o.term", "o.i")
    alone = asked.filter("n = 1").select("query", "doc_id", F.size("begins").cast("long").alias("times"))
    texts = _met(index, postings.drop("doc_id"), whole.select(F.explode(F.slice("words", F.lit(2), F.size("words") - 1)).alias("o")).select("o.term").distinct())
    met = asked.filter("n > 1").join(texts, ["shard", "row", "term"])
    fit = met.select("shard", "row", "doc_id", "q", "query", "n", F.array_intersect("begins", F.transform("positions", lambda p: p - F.col("i"))).alias("fit"))
    said = fit.select("shard", "row", "doc_id", "q", "query", "n", F.explode("fit").alias("begin")).groupBy("shard", "row", "doc_id", "q", "query", "n", "begin").agg(F.count(F.lit(1)).alias("said"))
    together = said.filter("said = n - 1").groupBy("shard", "row", "doc_id", "q", "query").agg(F.count(F.lit(1)).alias("times"))
    return together.select("query", "doc_id", "times").unionByName(alone)

"""A training-data pipeline over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; all but the last return the columns of ``documents``.

* ``quality``: documents that the line classifier rejects go.
* ``line_dedup``: later occurrences of repeated line windows are cut out of the
  texts (``n_chars`` follows); documents of which no line is left go.
* ``near_duplicates``: of each component of near duplicates the document with
  the smallest id stays, once: rows that repeat an id and its text are one.  Rows
  without an id stay, and so do rows of one id with other texts.
* ``decontaminate``: documents that hold a benchmark item go.
* ``pack``: what is left becomes token sequences, one row per piece.

Edge cases.  Null and empty texts are scored like other texts with no line, have
nothing to remove, are copies of nothing, and are packed as one end token if they
were kept.  Rows without an id go through all stages as documents of their own.
Of ties the smallest id counts; nulls in other columns and columns beyond those of
``documents`` pass through.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import decontaminate, frames, line_dedup, ngram_join, packing, quality
from stockweave.llm import queries as llm_queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, frames.labels(spark, sf_dir))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, removed, words = (frames.fresh(docs, x) for x in ("lines", "removed", "words"))
    done = line_dedup.dedup_lines(docs, counts=(lines, removed, words))
    left = done.filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    length = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone, row = frames.fresh(docs, "gone"), frames.fresh(docs, "row")
    found = ngram_join.near_duplicates(docs)
    later = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(later.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti")
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return left.withColumn(row, own).dropDuplicates(["doc_id", "text", row]).drop(row)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, llm_queries.tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: The stages use trained models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are kept in the shared folder."""
    docs = frames.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = frames.keep(docs)
    return docs

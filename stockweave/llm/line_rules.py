"""Quality rules: base counts and cross-document line frequency.

A line is normalised to its words in lower case (A-Z), one space between them,
and hashed.  Per host, the distinct documents with a line are counted; a line in
more than ``max(min_documents, share * documents of the host)`` of them is over
the limit and removed from that host's documents.  A document is depleted, and
rejected, if fewer than ``least_share`` of its words are left.

One pass over the texts gives a small row per document (counts, and its distinct
lines as hash and words), kept in the shared folder; texts are never shuffled.
Rows with a line are counted first, combined before the shuffle, so a line of a
third of all documents is one row per task; only for lines in more than
``min_documents`` rows are the distinct documents counted.  Such lines number at
most (all lines) / ``min_documents``; they are broadcast if they take less than
``BROADCAST_BYTES``, else joined with salted keys.

Edge cases.  Null and empty texts have no word and fail the base rule.  A null
host is a host of its own.  Rows that repeat an id are one document, with the lines
of all of them; rows without an id are a document each.  Lines
without a word are not lines.  An empty table gives none.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernel

MIN_DOCUMENTS = 20
SHARE = 0.01
LEAST_SHARE = 0.3
MIN_WORDS = 50
REPEAT_PERCENT = 50
BROADCAST_BYTES = 16 << 20
SALTS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FACTS = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))]


def _by_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def _key(text_of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes made distinct by text."""
    return kernel.mix(h + text_of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def block_facts(text: np.ndarray, starts: np.ndarray) -> dict:
    """Counts of each text of a block, and its distinct normalised lines."""
    k = len(starts) - 1
    s, e = kernel.words(text)
    of, offsets = kernel.per_text(starts, s)
    n_words = np.diff(offsets)
    separators = _by_text(np.isin(text, (9, 10, 11, 12, 13, 32)), starts)
    characters = _by_text((text & 0xC0) != 0x80, starts)
    word = kernel.span_hash(text, s, e)

    repeat = np.zeros(len(s), bool)
    if len(s) >= 3:
        three = kernel.shingles(word, 3)
        inside = of[:-2] == of[2:]
        at = np.flatnonzero(inside)
        _, back, count = np.unique(_key(of[at], three[at]), return_inverse=True, return_counts=True)
        hit = at[count[back] > 1]
        repeat[hit] = repeat[hit + 1] = repeat[hit + 2] = True
    n_repeat = np.bincount(of[repeat], minlength=k)

    line_end = np.flatnonzero(text == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    first = np.searchsorted(s, line_start)
    last = np.concatenate((first[1:], [len(s)])) if len(first) else first
    full = last > first
    line_start, line_end, first, last = line_start[full], line_end[full], first[full], last[full]
    line_of = np.searchsorted(starts, line_start, "right") - 1
    exact = np.unique(_key(line_of, kernel.span_hash(text, line_start, line_end)), return_index=True)[1]
    n_dup = np.bincount(line_of, minlength=k) - np.bincount(line_of[exact], minlength=k)

    low = kernel.span_hash(kernel.lower(text), s, e)
    line = kernel.run_hash(low, first, last)
    _, index, back = np.unique(_key(line_of, line), return_index=True, return_inverse=True)
    weight = np.bincount(back, weights=last - first, minlength=len(index)).astype(np.int64)
    order = np.argsort(index)
    index, weight = index[order], weight[order]
    return {
        "n_words": n_words,
        "word_chars": characters - separators,
        "n_symbols": _by_text(_SYMBOL[text], starts),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "lines": line[index].view(np.int64),
        "line_words": weight,
        "line_counts": np.bincount(line_of[index], minlength=k),
    }


def document_facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(2)):
                f = block_facts(text, starts)
                n = hi - lo
                columns = [np.arange(row, row + n), b.column(0).slice(lo, n), b.column(1).slice(lo, n)]
                columns += [f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns += [frames.lists(f["lines"], f["line_counts"], pa.int64()), frames.lists(f["line_words"], f["line_counts"], pa.int32())]
                row += n
                yield frames.batch(_FIELDS, columns)

    return frames.arrow(docs.select(F.col(id_column).cast("long"), F.col(host_column).cast("string"), text_column), run, _FACTS)


def _with_lines(line: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``line`` whose host and line are in ``some``, a kept table."""
    some = some.select(F.col("host").alias("over_host"), F.col("line").alias("over_line"))
    same = line["host"].eqNullSafe(some["over_host"]) & (line["line"] == some["over_line"])
    if some.count() * 48 <= BROADCAST_BYTES:
        return line.join(F.broadcast(some), same, "left_semi")
    salted = some.withColumn("over_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    mine = line.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    return mine.join(salted, mine["host"].eqNullSafe(salted["over_host"]) & (mine["line"] == salted["over_line"]) & (mine["salt"] == salted["over_salt"]), "left_semi").drop("salt")


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    share: float = SHARE,
    least_share: float = LEAST_SHARE,
    min_words: int = MIN_WORDS,
    repeat_percent: int = REPEAT_PERCENT,
) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``,
    ``n_removed_words`` (words on lines over the limit) and ``kept``."""
    facts = frames.keep(document_facts(docs, id_column, text_column, host_column))
    # A row without an id is a document of its own.
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    hosts = facts.groupBy("host").agg(F.countDistinct(document).alias("host_documents"))
    line = facts.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "doc_id", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    often = frames.keep(line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > min_documents).select("host", "line"))
    found = frames.keep(_with_lines(line, often))
    documents = found.groupBy("host", "line").agg(F.countDistinct(document).alias("documents")).filter(F.col("documents") > min_documents)
    over = documents.join(hosts, documents["host"].eqNullSafe(hosts["host"])).filter(F.col("documents") > F.lit(share) * F.col("host_documents")).select(documents["host"], "line")
    hit = _with_lines(found, frames.keep(over))
    removed = hit.groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0))
    return (
        facts.drop("lines", "line_words")
        .join(removed, "row", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), gone.alias("n_removed_words"),
            (~failed & (F.col("n_words") - gone >= F.lit(least_share) * F.col("n_words"))).alias("kept"),
        )
    )

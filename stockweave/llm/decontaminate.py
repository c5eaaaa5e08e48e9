"""Benchmark decontamination by an exact search of shingles, in DataFrame operations only.

Texts become words (runs of letters and digits, lower case), words 64-bit hashes.
A document's place is a run of as many words as the item has, clipped at the
document's begin and end; it holds the item if the multiplicity-weighted Jaccard similarity of their five-word shingles is
``SIMILARITY`` or more.

Search.  Every shingle of every document is looked up in a table of the items'
shingles; what meets is a hit: its position and how often the item has that shingle.
A place's similarity follows from the hits inside it and its length alone, so the
words aren't needed again.

Places.  Let a place begin at ``b``, before the document's first word if it is clipped
there.  A hit at ``at`` counts for it if it lies inside, and if the place has no more
hits of the same shingle up to it than the item has: both say that ``b`` is in one
interval, from ``at + k - item_n`` or behind the hit of the same shingle that is as many
hits before as the item has of it, to ``at``.  So a hit is two events on the line of
begins, and a running sum over a document's and item's events gives the overlap of
every place at once, in one sort, however long the item is or often it repeats.
Between two events the overlap is the same and the shortest place the best, which
is at one end; so both ends of each stretch are judged and nothing is missed, however
the passage was edited.

``distance`` is the Hamming distance of the 56-bit SimHash fingerprints (bit by bit
the majority of the words' hashes) of place and item; it's told, not a condition.

The item side is broadcast if it takes less than ``BROADCAST_BYTES``, else
joined by shuffle.  Documents' words aren't shuffled in the first case.

The shuffled join is salted on the documents' side, so that a shingle that a third
of all documents hold is not one task.

Edge cases.  Null and empty texts have no hits; items without a word are ignored.
Items of one to four words are one shingle, so only an exact run of them is a leak.
Items of equal text are found alike.  Repeated rows are as one; rows of
one id with other texts don't mix.  An empty table on either side gives no leak.
Other columns are ignored; :func:`decontaminate` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

SIMILARITY = 0.75
SHINGLE = 5
BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 64
SALTS = 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words; an empty array for a text without any."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def fingerprint(words: str) -> Column:
    """56 bits: each the majority of that bit in the words' hashes."""
    ones = f"aggregate({words}, 0, (n, w) -> n + CAST(shiftrightunsigned(w, j) & 1L AS INT))"
    return F.expr(f"aggregate(sequence(0, 55), 0L, (f, j) -> f | IF(2 * {ones} > size({words}), shiftleft(1L, j), 0L))")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of runs of words, with repeats; all words as one if there are fewer."""
    n = F.size(words) - size
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))))
    return F.when(n >= 0, many).otherwise(F.array(F.xxhash64(words)))


def runs(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words, by position; none if there are fewer words."""
    return F.expr(f"IF(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64(slice({words}, i + 1, {size}))), CAST(array() AS array<bigint>))")


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    items = benchmark.select(F.col(item_column).alias("item"), word_hashes(F.col(text_column)).alias("item_words"))
    items = items.select("*", F.size("item_words").alias("item_n"), F.xxhash64("item_words").alias("item_key")).filter("item_n >= 1")
    return items.dropDuplicates(["item", "item_key", "item_n"])


def found(docs: DataFrame, items: DataFrame, id_column: str, text_column: str, least: float) -> DataFrame | None:
    """The most similar place of each document and item: ``doc, item, best``; None without items."""
    sizes = sorted({min(r.item_n, SHINGLE) for r in items.select("item_n").distinct().collect()})
    if not sizes:
        return None
    index = items.select("item", "item_key", "item_n", F.explode(shingles(F.col("item_words"))).alias("key"))
    index = frames.keep(index.groupBy("item", "item_key", "item_n", "key").agg(F.count("*").cast("int").alias("times")))
    small = index.count() * _ROW_BYTES <= BROADCAST_BYTES

    words = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text_column).alias("text_key"), word_hashes(F.col(text_column)).alias("words"))
    rows = words.select("doc", "text_key", F.size("words").alias("size"), F.array(*[runs("words", k) for k in sizes]).alias("runs"))
    # The outer kinds, else Spark computes the arrays once more to filter empty ones.
    rows = rows.select("doc", "text_key", "size", F.explode_outer("runs").alias("run"))
    rows = rows.select("doc", "text_key", "size", F.posexplode_outer("run").alias("at", "key"))
    if small:
        met = rows.join(F.broadcast(index), "key")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "text_key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")

    group = ["doc", "text_key", "item", "item_key", "size", "item_n"]
    hits = met.repartition("doc", "text_key", "item").groupBy(*group, "key", "times").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # From where on the hit of each shingle that is ``times`` hits before is left out.
    hits = hits.select(*group, "times", F.posexplode("ats").alias("i", "at"), F.expr("concat(array_repeat(CAST(NULL AS INT), times), ats)").alias("earlier"))
    k = F.least("item_n", F.lit(SHINGLE))
    low = F.greatest(F.col("at") + k - F.col("item_n"), F.get("earlier", F.col("i")) + 1)  # greatest() passes over nulls
    event = lambda b, by: F.struct(b.cast("int").alias("b"), F.lit(by).alias("by"))
    events = hits.select(*group, F.explode(F.array(event(low, 1), event(F.col("at") + 1, -1))).alias("event")).select(*group, "event.*")
    line = Window.partitionBy("doc", "text_key", "item", "item_key", "size", "item_n").orderBy("b")
    swept = events.select(*group, "b", F.sum("by").over(line.rangeBetween(Window.unboundedPreceding, 0)).cast("int").alias("common"), F.lead("b").over(line).alias("next"))
    item_size = F.col("item_n") - k + 1
    swept = swept.filter(F.col("common") >= item_size * least)
    last = F.when(F.col("next") > F.col("b"), F.col("next") - 1).otherwise(F.col("b"))
    placed = swept.select("*", F.explode(F.array("b", last)).alias("from")).withColumn("begin", F.greatest(F.col("from"), F.lit(0)))
    placed = placed.withColumn("n", F.least(F.col("from") + F.col("item_n"), F.col("size")) - F.col("begin"))
    similarity = F.col("common") / (F.col("n") - k + 1 + item_size - F.col("common"))
    checked = placed.withColumn("similarity", similarity).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("b"), "n", "text_key", "item_key"))
    return checked.groupBy("doc", "item").agg(best.alias("best"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, start_word,
    n_words, similarity, distance`` of the most similar place, clipped to the document."""
    items = _items(benchmark, item_column, item_text_column)
    best = found(docs, items, id_column, text_column, least)
    if best is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, similarity double, distance int")
    best = frames.keep(best.select("doc", "item", "best.*"))
    small = best.count() * _ROW_BYTES <= BROADCAST_BYTES
    texts = docs.select(F.col(id_column).cast("long").alias("__doc"), F.xxhash64(text_column).alias("__key"), F.col(text_column).alias("__text"))
    there = texts.join(F.broadcast(best) if small else best, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__key") == F.col("text_key")))
    there = there.select("doc", "item", "similarity", "b", "n", "item_key", F.slice(word_hashes(F.col("__text")), 1 - F.col("b"), F.col("n")).alias("there"))
    side = items.select(F.col("item").alias("__item"), F.col("item_key").alias("__item_key"), "item_words")
    there = there.join(side, F.col("item").eqNullSafe(F.col("__item")) & (F.col("item_key") == F.col("__item_key"))).dropDuplicates(["doc", "item"])
    distance = F.bit_count(fingerprint("there").bitwiseXOR(fingerprint("item_words")))
    return there.select(
        F.col("doc").alias("doc_id"), F.col("item").cast("long").alias("item_id"), (-F.col("b")).cast("int").alias("start_word"),
        F.col("n").cast("int").alias("n_words"), "similarity", distance.cast("int").alias("distance"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents without a leak; rows with a null id stay."""
    best = found(docs, _items(benchmark, item_column, item_text_column), id_column, text_column, least)
    if best is None:
        return docs
    leak = frames.fresh(docs, "leak")
    return docs.join(best.select(F.col("doc").alias(leak)).distinct(), F.col(id_column) == F.col(leak), "left_anti")

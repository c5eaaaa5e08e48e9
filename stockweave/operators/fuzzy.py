"""A dictionary of words for edit distances, so that near words are found by an equi-join.

Words within ``k`` edits share a key, whatever the edits are:

* A word of up to ``LONGEST`` letters has as keys what is left of it when up to ``k``
  letters are deleted.  Two words within ``k`` edits have a common one: delete from
  each what the other lacks or has otherwise.
* A longer word, which would have too many of those, is cut into ``k + 1`` segments.
  ``k`` edits leave one of them untouched, and it stands in the other word no
  further than ``k`` places from where it was.

Which kind an entry of the dictionary has depends on its own length alone; a term
asks for both kinds if words of either length may be near.  Keys only make candidates;
the distance is computed for each, once.

The index is written once, bucketed by key, so asking moves the terms' keys only.  Its
size is bounded by the number of distinct words, not by the texts.

Null and empty words are none.  Repeated terms are answered once.  A term that is
itself a word is among its answers, at distance 0."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

LONGEST = 24
EDITS = 2


@dataclass(frozen=True)
class Dictionary:
    keys: DataFrame  # kind, key, word, n
    edits: int
    longest: int


def words_of(docs: DataFrame, tokens: Column) -> DataFrame:
    """``word, n``: distinct tokens with their number."""
    return docs.select(F.explode(tokens).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def deletions(word: Column, k: int) -> Column:
    """The distinct strings that are left when up to ``k`` letters are deleted."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = F.array(word)
    for _ in range(k):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def _segment(word: Column, length: Column, i: Column, k: int, shift: Column) -> tuple[Column, Column, Column]:
    """Key of segment ``i`` of ``k + 1`` of a word of that length, read ``shift`` places off; where it begins and ends."""
    cut = lambda j: F.floor(length * j / (k + 1)).cast("int")
    begin, end = cut(i) + shift, cut(i + 1) + shift
    return F.concat_ws("/", length, i, F.substring(word, begin + 1, end - begin)), begin, end


def segments(word: Column, k: int) -> Column:
    """Keys of a long word: its length, and each segment with its number."""
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: _segment(word, F.length(word), i, k, F.lit(0))[0])


def _segment_probes(term: Column, k: int, allowed: Column, longest: int) -> Column:
    """The keys that a long word near to the term may have: it has up to ``allowed`` letters
    more or less, and a segment stands up to so many places off."""
    n = F.length(term)
    tries = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for more in range(-k, k + 1) for i in range(k + 1) for shift in range(-k, k + 1)])

    def key(t: Column) -> Column:
        found, begin, end = _segment(term, n + t["more"], t["i"], k, t["shift"])
        return F.when((n + t["more"] > longest) & (begin >= 0) & (end <= n), found)

    near = F.filter(tries, lambda t: (F.abs(t["more"]) <= allowed) & (F.abs(t["shift"]) <= allowed))
    return F.array_distinct(F.array_compact(F.transform(near, key)))


def build(words: DataFrame, edits: int = EDITS, longest: int = LONGEST, buckets: int | None = None, folder: str | None = None) -> Dictionary:
    """Write the index of a dictionary ``(word, n)``."""
    spark = words.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = words.filter("word IS NOT NULL AND word <> ''").select("word", "n")
    short = F.length("word") <= longest
    keyed = F.when(short, F.transform(deletions(F.when(short, F.col("word")).otherwise(""), edits), lambda x: F.concat(F.lit("-"), x))).otherwise(segments(F.col("word"), edits))
    rows = words.select(F.explode(keyed).alias("key"), "word", "n")
    folder = folder or scratch.folder(spark, "dictionary")
    name = f"dictionary_{uuid.uuid4().hex}"
    rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", folder).saveAsTable(name)
    return Dictionary(spark.table(name), edits, longest)


def auto_edits(term: Column) -> Column:
    """No edit up to two letters, one up to five, then two."""
    n = F.length(term)
    return F.when(n < 3, 0).when(n < 6, 1).otherwise(2)


def near(dictionary: Dictionary, terms: DataFrame) -> DataFrame:
    """``term, word, distance, n``: the words within ``edits`` of each term ``(term, edits)``.

    ``edits`` must not be above the dictionary's."""
    k, longest = dictionary.edits, dictionary.longest
    asked = terms.filter("term IS NOT NULL AND term <> ''").select("term", F.least("edits", F.lit(k)).alias("edits")).distinct()
    plain = F.length("term") <= longest + k
    short = F.when(plain, F.transform(deletions(F.when(plain, F.col("term")).otherwise(""), k), lambda x: F.concat(F.lit("-"), x))).otherwise(F.array().cast("array<string>"))
    # Fewer edits need fewer deletions: a key is as much shorter than the term.
    short = F.filter(short, lambda x: F.length(x) - 1 >= F.length("term") - F.col("edits"))
    long = F.when(F.length("term") + F.col("edits") > longest, _segment_probes(F.col("term"), k, F.col("edits"), longest)).otherwise(F.array().cast("array<string>"))
    probes = asked.select("term", "edits", F.explode(F.concat(short, long)).alias("key"))
    met = dictionary.keys.join(probes, "key").filter(F.abs(F.length("word") - F.length("term")) <= F.col("edits")).select("term", "edits", "word", "n").distinct()
    far = F.levenshtein("term", "word")
    return met.withColumn("distance", far).filter(F.col("distance") <= F.col("edits")).select("term", "word", "distance", "n")


def expansions(dictionary: Dictionary, terms: list[str], edits: int | None = None) -> dict[str, list[str]]:
    """A query's few terms with the words that are near to each, to match as alternatives."""
    asked = dictionary.keys.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    asked = asked.withColumn("edits", F.lit(edits) if edits is not None else auto_edits(F.col("term")))
    found: dict[str, list[str]] = {t: [] for t in terms}
    for r in near(dictionary, asked).select("term", "word").toLocalIterator():  # words near to one term
        found[r.term].append(r.word)
    return found

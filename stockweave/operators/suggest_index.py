"""A stored index of suggestions, and snapshots of it that readers swap in.

A record ``(text, secondary, weight)`` is found by what any of its words, and what
follows it, begins with.  Keys are the first letters of these word beginnings, in lower
case: of each length below ``KEY`` with the ``keep`` best records, and of length ``KEY``
with all of them.  A shorter query is a key itself, so its best records are stored
ready; a longer one is compared with the records of its first ``KEY`` letters.  So a
batch of queries is answered by one join on the key, and nothing is left out for
limits up to ``keep``.

Order: found in the text (stage 1) before the secondary text (stage 2), then the weight,
then the text.  Of records with one text the heaviest counts.  Null and empty texts
are no records, null weights weigh nothing; blank queries find nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

KEY, KEEP = 6, 100


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def _beginnings(c: Column) -> Column:
    """The text from each of its words on."""
    words = F.split(_normal(c), " ")
    return F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))


def index(records: DataFrame, keep: int = KEEP) -> DataFrame:
    """``key, begins, text, stage, weight``; ``begins`` is null where the key alone decides."""
    one = records.filter("text IS NOT NULL AND trim(text) <> ''").groupBy("text").agg(F.max_by("secondary", F.struct(F.coalesce("weight", F.lit(0)), "secondary")).alias("secondary"), F.max(F.coalesce("weight", F.lit(0))).alias("weight"))
    text = F.transform(_beginnings(F.col("text")), lambda b: F.struct(b.alias("begins"), F.lit(1).alias("stage")))
    second = F.transform(_beginnings(F.col("secondary")), lambda b: F.struct(b.alias("begins"), F.lit(2).alias("stage")))
    rows = one.select("text", "weight", F.inline(F.concat(text, second))).filter("begins <> ''")
    lengths = F.sequence(F.lit(1), F.least(F.length("begins"), F.lit(KEY)))
    keyed = rows.withColumn("key", F.explode(F.transform(lengths, lambda n: F.substring(F.col("begins"), F.lit(1), n))))
    whole = keyed.filter(F.length("key") == KEY).select("key", "begins", "text", "stage", "weight").distinct()
    short = keyed.filter(F.length("key") < KEY).groupBy("key", "text").agg(F.min("stage").alias("stage"), F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("stage", F.col("weight").desc(), "text"))
    best = short.withColumn("r", rank).filter(F.col("r") <= keep)  # tasks keep their own best before the shuffle
    return whole.unionByName(best.select("key", F.lit(None).cast("string").alias("begins"), "text", "stage", "weight"))


def lookup(stored: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query, text, stage, weight, rank`` of the best suggestions of each query."""
    q = queries.select("query", _normal(F.col("query")).alias("q")).distinct().filter("q <> ''").withColumn("key", F.substring("q", 1, KEY))
    met = q.join(stored, "key").filter("begins IS NULL OR startswith(begins, q)")
    one = met.groupBy("query", "text").agg(F.min("stage").alias("stage"), F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("stage", F.col("weight").desc(), "text"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= limit)


def publish(store: Store, name: str, locale: str, records: DataFrame, keep: int = KEEP) -> bool:
    """A new snapshot of the index, made live as a whole."""
    session = store.start(name, locale)
    store.add(session, index(records, keep))
    return store.deploy(session)


@dataclass
class Poller:
    """A reader's view of a name's live snapshot.

    :meth:`current` asks for the modification time; only a newer one is loaded.  The
    frame that a reader has keeps its files, since the version before the live one stays."""

    store: Store
    name: str
    loaded: tuple[int, int] = (0, 0)
    frame: DataFrame | None = None

    def current(self) -> DataFrame | None:
        stamp = self.store.modified(self.name)
        if stamp is not None and stamp > self.loaded:
            self.frame, self.loaded = self.store.read(self.name).drop("_index"), stamp
        return self.frame

"""Scoring functions, sorting, variant picking and result arrangement."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

MODIFIERS: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x, "log": F.log10, "log1p": lambda x: F.log10(x + 1), "log2p": lambda x: F.log10(x + 2), "ln": F.log, "ln1p": lambda x: F.log(x + 1),
    "ln2p": lambda x: F.log(x + 2), "square": lambda x: x * x, "sqrt": F.sqrt, "reciprocal": lambda x: 1 / x,
}


def field_value(value: Column, factor: float = 1.0, modifier: str = "none", missing: float = 0.0, weight: float = 1.0) -> Column:
    return MODIFIERS[modifier](F.coalesce(value, F.lit(missing)) * factor) * weight


def decay(value: Column, kind: str, origin: float | str, scale: float, offset: float = 0.0, rate: float = 0.5) -> Column:
    """1 at the origin, ``rate`` at the distance ``scale`` beyond the offset."""
    if isinstance(origin, str):  # a date: distances are in days
        value, origin = F.unix_micros(value.cast("timestamp")) / 86_400_000_000.0, F.unix_micros(F.lit(origin).cast("timestamp")) / 86_400_000_000.0
    far = F.greatest(F.abs(value - origin) - offset, F.lit(0.0))
    if kind == "gauss":
        return F.exp(far * far * (math.log(rate) / scale**2))
    if kind == "exp":
        return F.exp(far * (math.log(rate) / scale))
    return F.greatest(F.lit(0.0), (scale / (1 - rate) - far) / (scale / (1 - rate)))


def random_score(key: Column, seed: int | None) -> Column:
    return F.rand() if seed is None else F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0


def rank_feature(features: Column, name: str, kind: str = "saturation", pivot: float = 1.0, exponent: float = 1.0, scaling: float = 1.0, missing: float = 0.0) -> Column:
    x = F.element_at(features, name)
    some = {
        "linear": x, "log": F.log(scaling + x), "saturation": x / (x + pivot),
        "sigmoid": F.pow(x, F.lit(exponent)) / (F.pow(x, F.lit(exponent)) + pivot**exponent),
    }[kind]
    return F.coalesce(some, F.lit(missing))


def combine(scores: list[Column], mode: str = "avg") -> Column:
    """Of several functions: multiply, avg, sum, min, max, first."""
    if mode == "first":
        return scores[0]
    if mode in ("min", "max"):
        return reduce(lambda a, b: (F.least if mode == "min" else F.greatest)(a, b), scores)
    total = reduce(Column.__mul__ if mode == "multiply" else Column.__add__, scores)
    return total / float(len(scores)) if mode == "avg" else total


def boost(text: Column, function: Column, mode: str = "avg") -> Column:
    """Text score with the functions' score."""
    return function if mode == "replace" else combine([text, function], mode)


def up_down(score: Column, matches: Column, up: float = 0.0, down: float | None = None) -> Column:
    """Up adds; down multiplies by its factor, or by its reciprocal if that is above one."""
    if down is not None:
        return score * F.when(matches, F.lit(1 / down if down > 1 else down)).otherwise(1.0)
    return score + F.when(matches, F.lit(up)).otherwise(0.0)


def _inside(hits: DataFrame, window: int) -> Column | None:
    """Whether a hit is one of the top ones, by the last row of these; none if there are none."""
    top = hits.orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(window)
    last = top.orderBy(F.col("score").asc_nulls_first(), F.col("doc_id").desc()).select("score", "doc_id").first() if window else None
    if last is None:
        return None
    better = F.lit(True) if last.score is None else F.col("score") > F.lit(last.score)
    return F.coalesce(better & F.col("score").isNotNull(), F.lit(False)) | (F.col("score").eqNullSafe(F.lit(last.score)) & (F.col("doc_id") <= F.lit(last.doc_id)))


def rescore(hits: DataFrame, window: int, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A second scorer on the top hits; the others stay behind them, in their order."""
    inside = _inside(hits, window)
    tail = hits.filter(F.lit(True) if inside is None else ~inside).withColumn("tier", F.lit(1))
    return tail if inside is None else scorer(hits.filter(inside)).withColumn("tier", F.lit(0)).unionByName(tail, allowMissingColumns=True)


@dataclass(frozen=True, eq=False)
class Rescorer:
    """A second score for those of the top ``window`` hits that match.

    A hit's new score is ``query_weight`` times the old one, and if it is in the window
    and matches, plus ``weight`` times the second."""

    window: int
    matches: Column
    score: Column
    query_weight: float = 1.0
    weight: float = 1.0


def rescored(hits: DataFrame, rescorers: list[Rescorer], sets: int = 0, heroes: int = 0) -> DataFrame:
    """Rescorers one after another, each on the order that the one before it left.

    ``hits`` with ``set_no`` and ``pos`` of ``sets`` product sets hold ``heroes`` hits in
    front.  A rescorer whose window ends within these is left out.  Where the others weaken
    the query against their own scores, heroes get that much of their boost again, in the
    largest window asked for, so that they stay in front."""
    used = [r for r in rescorers if r.window > heroes]
    query, own = math.prod(r.query_weight for r in used), math.prod(r.weight for r in used)
    if heroes and query < own:
        used.append(Rescorer(max(r.window for r in rescorers), F.col("pos").isNotNull(), hero_score(sets), 1.0, own - query))
    for r in used:
        inside = _inside(hits, r.window)
        if inside is not None:
            second = F.when(inside & F.coalesce(r.matches, F.lit(False)), F.coalesce(r.score, F.lit(0.0)) * r.weight).otherwise(0.0)
            hits = hits.withColumn("score", F.col("score") * r.query_weight + second)
    return hits


def sort_columns(instructions: list, with_score: bool = True) -> list[Column]:
    """Ascending sorts take the least, descending ones the greatest of ``<field>_lo/_hi``; ties go by score, then id."""
    out = [(F.coalesce(F.col(f"{s.field}_hi"), F.lit(s.missing).try_cast("double")).desc() if s.descending else F.coalesce(F.col(f"{s.field}_lo"), F.lit(s.missing).try_cast("double")).asc()) for s in instructions]
    return out + ([F.col("score").desc()] if with_score else []) + [F.col("doc_id").asc()]


def positions(df: DataFrame, order: list[Column], first: int = 1) -> DataFrame:
    """Adds ``pos``, the place in an order, for all rows.

    One range sort, written once with each row's partition and place in it; the sizes of
    partitions are counted on that table, and its rows numbered behind those of the
    partitions before them.  So numbers don't depend on a second sort having the same
    partitions."""
    part, at, before = "__part", "__at", "__before"
    ordered = df.sort(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = scratch.keep(ordered, "sorted")
    sizes = {r[part]: r["count"] for r in kept.groupBy(part).count().collect()}  # one row a partition
    starts, total = [], first
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    return kept.join(F.broadcast(offsets), part).withColumn("pos", F.col(before) + F.col(at)).drop(part, at, before)


def facet_value_sort(docs: DataFrame, values: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Sort by a nested value: ``sort_value`` is the least or greatest of the entry's."""
    own = values.filter(F.col("name") == name).groupBy("doc_id").agg((F.max if descending else F.min)("num_value").alias("sort_value"))
    return docs.join(own, "doc_id", "left")


def page(df: DataFrame, order: list[Column], limit: int = 12, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pick_variant(variants: DataFrame, strategy: str = "pickIfBestScored") -> DataFrame:
    """The variant that stands for its product, if one does: ``doc_id, variant_pos``.

    ``variants`` are the matching ones with a ``score`` and the product's number of
    variants, ``n_variants``."""
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "variant_pos")
    ranked = variants.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    ranked = ranked.withColumn("hits", size).filter("r = 1")
    rule = {
        "pickAlways": F.lit(True), "pickIfSingleHit": F.col("hits") == 1, "pickIfDrilledDown": F.col("hits") < F.col("n_variants"),
        "pickIfBestScored": (F.col("hits") == 1) | (F.col("score") > F.col("next")),
    }[strategy]
    return ranked.filter(rule).select("doc_id", "variant_pos")


def price_prefix(low: Column, high: Column) -> Column:
    """``from`` if a sorted number has several values."""
    return F.when(low < high, F.lit("from"))


def hero_boost(hits: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """Scores of the better of query and hero: a set's boost is a thousand times the
    next one's, and 10 for the last; places in it give 1000, 999 and so on."""
    own = F.when(F.col("pos").isNotNull(), hero_score(len(sets))).otherwise(0.0)
    return arrange(hits, sets).withColumn("score", F.greatest(F.col("score"), own))


def hero_score(sets: int) -> Column:
    """What a place ``pos`` in set ``set_no`` is worth."""
    return F.pow(F.lit(1000.0), F.lit(sets - 1) - F.col("set_no")) * 10.0 * F.greatest(F.lit(1000) - F.col("pos"), F.lit(1))


def arrange(hits: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """Ordered sets ``(doc_id, pos)`` before the hits; an id counts where it comes
    first, unknown ids are left out.  Adds ``set_no`` and ``pos``."""
    listed = reduce(DataFrame.unionByName, [s.select("doc_id", F.lit(i).alias("set_no"), "pos") for i, s in enumerate(sets)])
    first = listed.groupBy("doc_id").agg(F.min(F.struct("set_no", "pos")).alias("p")).select("doc_id", "p.set_no", "p.pos")
    return hits.join(first, "doc_id", "left").withColumn("set_no", F.coalesce("set_no", F.lit(len(sets))))

"""Product sets: the ids that are put before the hits, by kind of set.

A resolver takes ``(set, docs, used)`` and gives ``doc_id, pos``; ``used`` are ids
that earlier sets have taken.  Kinds beyond the four are plug-ins."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from . import querystring
from .extensions import Registry
from .params import SearchRequest
from .search import Stage, staged_search


@dataclass(frozen=True)
class ProductSet:
    kind: str  # static, dynamic, querystring, or a plug-in's name
    name: str = ""
    ids: tuple = ()  # static: ids, or values of ``field``
    field: str | None = None
    query: str = ""
    weights: dict = dataclasses.field(default_factory=dict)
    sort: tuple[tuple[str, bool], ...] = ()  # dynamic: field, descending
    limit: int = 3
    separate: bool = False  # a slice of its own; else its hits lead the main one


def _numbered(found: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first few as a set; a request's number of rows is numbered, not the table's."""
    top = found.orderBy(*order, "doc_id").limit(limit)
    return top.select("doc_id", (F.row_number().over(Window.orderBy(*order, "doc_id")) - 1).cast("long").alias("pos"))


def static_set(s: ProductSet, docs: DataFrame, used: DataFrame | None) -> DataFrame:
    """Known ids in the order given, each once; several documents of one value by id."""
    column = s.field or "doc_id"
    given = list(dict.fromkeys(s.ids))
    kind = docs.schema[column].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(v, i) for i, v in enumerate(given)], f"__v {kind}, __i int")
    # The list is a request's.
    found = docs.join(F.broadcast(wanted), docs[column] == F.col("__v")).select("doc_id", "__i")
    free = _free(found, used)
    if s.field is None:  # no more rows than the list has ids
        return _numbered(free, [F.col("__i")], len(given) or 1)
    return positions(free, [F.col("__i"), F.col("doc_id")], 0).select("doc_id", "pos")


def _free(found: DataFrame, used: DataFrame | None) -> DataFrame:
    return found if used is None else found.join(used.select("doc_id"), "doc_id", "left_anti")


def resolve(sets: list[ProductSet], docs: DataFrame, tokens: Column, fields: dict[str, Column], registry: Registry | None = None) -> list[DataFrame]:
    """One frame ``doc_id, pos`` per set; an id is in the first set that has it."""
    out: list[DataFrame] = []
    for s in sets:
        used = reduce(DataFrame.unionByName, out) if out else None
        if s.kind == "static":
            found = static_set(s, docs, used)
        elif s.kind == "dynamic":
            hits = staged_search(docs, tokens, SearchRequest(s.query), [Stage("all", "all"), Stage("any", "any")]).hits if s.query else docs.withColumn("score", F.lit(1.0))
            order = [F.col(f).desc() if down else F.col(f).asc() for f, down in s.sort] or [F.col("score").desc()]
            found = _numbered(_free(hits, used), order, s.limit)
        elif s.kind == "querystring":
            hits = querystring.search(docs, s.query, {n: c for n, c in fields.items() if not s.weights or n in s.weights}, s.weights)
            found = _numbered(_free(hits, used), [F.col("score").desc()], s.limit)
        else:
            plugin = registry.get("product_set", s.kind) if registry else None
            found = plugin(s, docs, used) if plugin else docs.select("doc_id", F.lit(None).cast("long").alias("pos")).filter(F.lit(False))
        out.append(found.select("doc_id", "pos"))
    return out

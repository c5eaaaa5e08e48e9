"""Filters as semi and anti joins on the exploded facet values.

A condition holds for one entry: name and value are of the same row.  Filters on
variants are conjoined on one variant before they are lifted to the product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import Filter


def condition(f: Filter) -> Column:
    """The predicate on ``facet_values`` of one filter, leaving out its negation."""
    name = F.col("name") == f.field
    if f.kind == "number":
        ends = [F.col("num_value") >= f.low] if f.low is not None else []
        ends += [F.col("num_value") <= f.high] if f.high is not None else []
        return reduce(Column.__and__, ends, name & F.col("num_value").isNotNull())
    column = "value_id" if f.kind in ("id", "path_id") else "value_norm"
    return name & F.col(column).isin(*f.values)


def level_rows(facet_values: DataFrame, level: str) -> DataFrame:
    if level == "MASTER":
        return facet_values.filter("variant_pos IS NULL")
    return facet_values.filter("variant_pos IS NOT NULL") if level == "VARIANT" else facet_values


def matching(facet_values: DataFrame, f: Filter) -> DataFrame:
    """Products with an entry that meets the filter, on its level or either."""
    return level_rows(facet_values, f.level).filter(condition(f)).select("doc_id").distinct()


def apply_filter(docs: DataFrame, facet_values: DataFrame, f: Filter) -> DataFrame:
    """Kept documents; a negated filter excludes documents that match on any of its levels."""
    return docs.join(matching(facet_values, f), "doc_id", "left_anti" if f.negate else "left_semi")


def same_variant(variants: DataFrame, *conditions: Column) -> DataFrame:
    """Products with one variant that meets all conditions."""
    return variants.filter(reduce(Column.__and__, conditions)).select("doc_id").distinct()


def apply_filters(docs: DataFrame, facet_values: DataFrame, filters: list[Filter]) -> DataFrame:
    """All filters.  Positive variant filters must meet on one variant: each adds a
    bit for a variant, and the bits of one variant must be all of them."""
    merged: dict[str, Filter] = {}
    for f in filters:
        at = f"{f.field}/{f.kind}"
        merged[at] = merged[at].merge(f) if at in merged else f
    on_variant = [f for f in merged.values() if f.level == "VARIANT" and not f.negate]
    for f in merged.values():
        if f not in on_variant:
            docs = apply_filter(docs, facet_values, f)
    if len(on_variant) == 1:
        docs = apply_filter(docs, facet_values, on_variant[0])
    elif on_variant:
        bit = reduce(lambda c, p: c.when(condition(p[1]), F.lit(1 << p[0])), list(enumerate(on_variant))[1:], F.when(condition(on_variant[0]), F.lit(1)))
        rows = level_rows(facet_values, "VARIANT").filter(reduce(Column.__or__, [condition(f) for f in on_variant])).withColumn("bit", bit)
        met = rows.groupBy("doc_id", "variant_pos").agg(F.expr("bit_or(bit)").alias("bits")).filter(F.col("bits") == (1 << len(on_variant)) - 1)
        docs = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs


def column_condition(f: Filter, columns: list[str]) -> Column:
    """The predicate of a filter on columns of the table itself; a scan can push it."""
    def one(name: str) -> Column:
        c = F.col(name)
        if f.kind == "number":
            ends = [c >= f.low] if f.low is not None else []
            ends += [c <= f.high] if f.high is not None else []
            return reduce(Column.__and__, ends, c.isNotNull())
        return F.lower(c.cast("string")).isin(*f.values)

    return F.coalesce(reduce(Column.__or__, [one(c) for c in columns]), F.lit(False))


def filter_products(docs: DataFrame, filters: list[Filter], master: dict[str, list[str]], variants: DataFrame | None = None, child: dict[str, list[str]] | None = None) -> DataFrame:
    """All filters, where values are columns: those of products are predicates, those
    of variants one scan of these and a semi join, since they must meet on one row."""
    merged: dict[str, Filter] = {}
    for f in filters:
        at = f"{f.field}/{f.kind}"
        merged[at] = merged[at].merge(f) if at in merged else f
    inner = []
    for f in merged.values():
        if f.level == "VARIANT" and not f.negate:
            inner.append(column_condition(f, child[f.field]))
        elif f.level == "VARIANT":
            docs = docs.join(same_variant(variants, column_condition(f, child[f.field])), "doc_id", "left_anti")
        else:
            hit = column_condition(f, master[f.field])
            docs = docs.filter(~hit if f.negate else hit)
    return docs.join(same_variant(variants, *inner), "doc_id", "left_semi") if inner else docs


def split_filters(filters: list[Filter], facets: dict[str, dict], wanted: bool = True) -> tuple[list[Filter], list[Filter]]:
    """Basic and post filters.  A filter on a multi-select facet restricts hits
    only, so that the facet shows its other values; not if it is negated, came
    from a rule, or its facet is filter-sensitive, or no facets are wanted."""
    post = []
    for f in filters:
        c = facets.get(f.field, {})
        multi = c.get("multi_select") or c.get("show_unselected") or c.get("type") == "range"
        if wanted and multi and not c.get("filter_sensitive") and not f.negate and not f.induced:
            post.append(f)
    return [f for f in filters if f not in post], post


def top_variants(variants: DataFrame, order: list[Column], n: int = 2) -> DataFrame:
    """The first ``n`` variants of each product."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "variant_pos"))
    return variants.withColumn("rank", rank).filter(F.col("rank") <= n)

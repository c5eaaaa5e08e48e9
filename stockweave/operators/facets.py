"""Facets: grouped counts over exploded values, counting products once each.

All take ``facet_values`` rows of the matched documents.  Several facets share
one aggregation pass; post filters are applied per facet in that same pass."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries that a term and a path facet keep, and the histogram's width.
TERM_LIMIT, PATH_LIMIT, INTERVAL = 100, 250, 5.0


@dataclass(frozen=True)
class FacetConfig:
    name: str
    type: str | None = None
    label: str | None = None
    order: int = 127
    multi_select: bool = False
    show_unselected: bool = False
    filter_sensitive: bool = False
    exclude_from_limit: bool = False
    min_value_count: int = 2
    min_coverage: float = 0.1
    value_order: str = "COUNT"
    remove_on_single: bool = False
    dependencies: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)


def default_type(field_type: str) -> str:
    return {"NUMBER": "interval", "CATEGORY": "hierarchical"}.get(field_type, "term")


def _top(df: DataFrame, n: int, *by: str, order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def term_facet(values: DataFrame, limit: int = TERM_LIMIT) -> DataFrame:
    """``name, value, doc_count``: the top values of each name, then variants of
    case merged, the most frequent spelling being the label, counts added."""
    raw = values.groupBy("name", "value", "value_norm").agg(F.countDistinct("doc_id").alias("n"))
    top = _top(raw, limit, "name", order=[F.col("n").desc(), "value"])
    return top.groupBy("name", "value_norm").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.sum("n").alias("doc_count")).drop("value_norm")


def path_facet(values: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """``name, path, level, doc_count``: every ancestor is a stored value, so no rollup is needed."""
    n = values.groupBy("name", F.col("value").alias("path")).agg(F.countDistinct("doc_id").alias("doc_count"))
    return _top(n.withColumn("level", F.size(F.split("path", "/"))), limit, "name", order=[F.col("doc_count").desc(), "path"])


def category_tree(values: DataFrame, selected: tuple[str, ...] = (), limit: int = PATH_LIMIT, keep: tuple[str, ...] = ()) -> list[dict]:
    """The tree of the most frequent paths, with ids; ``keep`` and what they are under
    are in it anyway.  ``values`` has ``doc_id, value, value_id``."""
    n = values.groupBy(F.col("value").alias("path")).agg(F.countDistinct("doc_id").alias("doc_count"), F.min("value_id").alias("id"))
    above = {"/".join(p.split("/")[: i + 1]) for p in keep for i in range(p.count("/") + 1)}
    rows = {r.path: r for r in n.orderBy(F.col("doc_count").desc(), "path").limit(limit).collect()}
    rows |= {r.path: r for r in n.filter(F.col("path").isin(*above)).collect()} if above else {}
    tree = path_tree([(r.path, r.doc_count) for r in rows.values()], selected)
    for e in flat(tree):
        e["id"] = rows[e["path"]].id
    return tree


def flat(tree: list[dict]) -> list[dict]:
    """A tree's entries, parents first."""
    return [x for e in tree for x in (e, *flat(e["children"]))]


def path_tree(rows: list[tuple[str, int]], selected: tuple[str, ...] = ()) -> list[dict]:
    """Paths and counts as a tree; siblings of a selected path are left out."""
    root: list[dict] = []
    index: dict[str, dict] = {}
    for path, n in sorted(rows):
        parent, _, key = path.rpartition("/")
        entry = {"key": key, "path": path, "doc_count": n, "selected": path.lower() in selected, "children": []}
        (index[parent]["children"] if parent in index else root).append(entry)
        index[path] = entry

    def inside(e: dict) -> bool:
        return e["selected"] or any(inside(c) for c in e["children"])

    def prune(entries: list[dict]) -> list[dict]:
        kept = [e for e in entries if inside(e)] or entries
        for e in kept:
            e["children"] = prune(e["children"])
        return kept

    return prune(root)


def histogram(values: DataFrame, width: float = INTERVAL) -> DataFrame:
    """``name, lower, doc_count`` in buckets of one width."""
    low = (F.floor(F.col("num_value") / width) * width).cast("double")
    return values.filter("num_value IS NOT NULL").groupBy("name", low.alias("lower")).agg(F.countDistinct("doc_id").alias("doc_count"))


def merge_intervals(buckets: DataFrame, width: float = INTERVAL, optimal: int = 5) -> DataFrame:
    """Greedy: neighbours are joined until each holds a fair share of the total.

    A fold over each facet's buckets, which are few: ``name, lower, upper, doc_count``."""
    listed = buckets.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("lower", "doc_count"))).alias("b"), F.sum("doc_count").alias("total"))
    fair = F.col("total") / optimal
    kind = "array<struct<lower:double,upper:double,doc_count:bigint>>"

    def add(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        one = F.struct(b["lower"].alias("lower"), (b["lower"] + (width - 0.01)).alias("upper"), b["doc_count"].alias("doc_count"))
        joined = F.struct(last["lower"].alias("lower"), (b["lower"] + (width - 0.01)).alias("upper"), (last["doc_count"] + b["doc_count"]).alias("doc_count"))
        grow = (F.size(done) > 0) & (last["doc_count"] < fair)
        return F.when(grow, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(one))).cast(kind)

    return listed.select("name", F.explode(F.aggregate("b", F.array().cast(kind), add)).alias("e")).select("name", "e.*")


def fixed_ranges(values: DataFrame, ranges: list[tuple[float | None, float | None, str]]) -> DataFrame:
    """``[from, to)`` ranges with labels: ``name, label, doc_count``."""
    v = F.col("num_value")
    conds = [(reduce(Column.__and__, ([v >= a] if a is not None else []) + ([v < b] if b is not None else []), F.lit(True)), label) for a, b, label in ranges]
    label = reduce(lambda c, p: c.when(*p), conds[1:], F.when(*conds[0]))
    return values.withColumn("label", label).filter("label IS NOT NULL").groupBy("name", "label").agg(F.countDistinct("doc_id").alias("doc_count"))


def range_facet(values: DataFrame) -> DataFrame:
    """Ends and count; not if there is one value only.  Low ends round half down, high ones half up."""
    r = values.filter("num_value IS NOT NULL").groupBy("name").agg(F.min("num_value").alias("lo"), F.max("num_value").alias("hi"), F.count(F.lit(1)).alias("doc_count"))
    low, high = F.ceil(F.col("lo") * 100 - 0.5) / 100, F.floor(F.col("hi") * 100 + 0.5) / 100
    return r.filter("lo <> hi AND doc_count > 1").select("name", low.alias("lower"), high.alias("upper"), "doc_count")


def exclusive_facets(values: DataFrame, selections: dict[str, Column], marks: DataFrame) -> DataFrame:
    """Counts of each facet under all post filters but its own, in one pass.

    ``marks`` has one row per document and a boolean column ``sel_<name>`` per
    selection: whether the document meets it.  A value of facet f counts a
    document if every other selection holds."""
    joined = values.join(marks, "doc_id")
    allowed = reduce(Column.__and__, [F.col(f"sel_{n}") | (F.col("name") == n) for n in selections], F.lit(True))
    return joined.filter(allowed).groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count"))


def selection_marks(docs: DataFrame, values: DataFrame, selections: dict[str, Column]) -> DataFrame:
    """``doc_id`` and whether it has a value that meets each selection."""
    hit = values.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col("name") == n) & c), F.lit(False)).alias(f"sel_{n}") for n, c in selections.items()])
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", *[F.coalesce(f"sel_{n}", F.lit(False)).alias(f"sel_{n}") for n in selections])


def exclusive_facets_on_variants(values: DataFrame, master: dict[str, Column], variant: dict[str, Column]) -> DataFrame:
    """Counts of each facet under all post filters but its own, where filters are on both levels.

    A facet of variants counts a product by the variants that meet all other variant
    filters themselves, of products that meet the master filters; a facet of products
    counts those with *one* variant that meets all variant filters.  Conditions are on
    the rows ``(doc_id, variant_pos, name, value, ..)``; ``variant_pos`` is null on the
    master level.

    Each filter is a bit.  The bits that a variant's rows meet are put together
    variant by variant, then the products' by product; a row counts if what it needs is
    in them.  A product without a variant meets no variant filter."""
    bits = {n: 1 << i for i, n in enumerate([*master, *variant])}
    all_master, all_variant = sum(bits[n] for n in master), sum(bits[n] for n in variant)
    met = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce((F.col("name") == n) & c, F.lit(False)), F.lit(bits[n])).otherwise(0) for n, c in {**master, **variant}.items()], F.lit(0))
    owned = values.groupBy("doc_id", "variant_pos").agg(F.bit_or(met).alias("own"))
    on_variant = F.col("variant_pos").isNotNull()
    whole = F.coalesce(F.bool_or(on_variant & (F.col("own").bitwiseAND(F.lit(all_variant)) == all_variant)), F.lit(False)) if variant else F.lit(True)
    product = owned.groupBy("doc_id").agg(F.coalesce(F.bit_or(F.when(~on_variant, F.col("own"))), F.lit(0)).alias("product"), whole.alias("whole"))
    # A row needs the bits of all other filters of its level.
    own_bit = reduce(lambda c, p: c.when(F.col("name") == p[0], F.lit(p[1])), bits.items(), F.when(F.lit(False), F.lit(0))).otherwise(0)
    lacks = lambda have, need: F.lit(need).bitwiseAND(F.bitwise_not(have.bitwiseOR(own_bit)))
    marked = values.select("doc_id", "variant_pos", "name", "value").alias("v").join(owned.alias("o"), (F.col("v.doc_id") == F.col("o.doc_id")) & F.col("v.variant_pos").eqNullSafe(F.col("o.variant_pos")))
    marked = marked.select("v.*", "own").join(product, "doc_id")
    fits = F.when(on_variant, lacks(F.col("own"), all_variant) == 0).otherwise(F.col("whole"))
    kept = marked.filter((lacks(F.col("product"), all_master) == 0) & fits)
    return kept.groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count"))


def merge_levels(entries: DataFrame) -> DataFrame:
    """The same facet of products and variants: the larger count of each value."""
    return entries.groupBy("name", "value").agg(F.max("doc_count").alias("doc_count"))


def coverage(entries: DataFrame) -> DataFrame:
    """Coverage is the sum of entry counts, not of distinct documents."""
    return entries.groupBy("name").agg(F.sum("doc_count").alias("coverage"), F.count(F.lit(1)).alias("entries"))


def visible(stats: DataFrame, matches: int, configs: dict[str, FacetConfig], filtered: set[str]) -> DataFrame:
    """Facets that cover enough matches with enough values; filtered ones always stay."""
    def by(attribute: str, default) -> Column:
        return F.coalesce(*[F.when(F.col("name") == n, F.lit(getattr(c, attribute))) for n, c in configs.items()], F.lit(default))

    active = F.col("name").isin(*filtered) if filtered else F.lit(False)
    enough = (F.col("coverage") / F.lit(max(matches, 1)) >= by("min_coverage", 0.1)) & (F.col("entries") >= by("min_value_count", 2))
    single = by("remove_on_single", False) & (F.col("entries") == 1) & (F.col("coverage") >= matches)
    return stats.filter(active | (enough & ~single))


def dependency_met(condition: str, selected: dict[str, tuple[str, ...]], custom: dict[str, str] | None = None) -> bool:
    """``a=x,y&b=*``: all parts hold.  Of a part's values, all must be selected; where no
    filter is on the field, a custom parameter may be one of them.  Values compare
    without case; a path also covers its descendants."""
    for part in filter(None, condition.split("&")):
        name, _, wanted = part.partition("=")
        values = {w.lower() for w in wanted.split(",") if w}
        have = [h.lower() for h in selected.get(name, ())]
        if not have:
            own = (custom or {}).get(name)
            if own is None or ("*" not in values and own.lower() not in values):
                return False
        elif "*" not in values and not all(any(h == w or h.startswith(w + "/") for h in have) for w in values):
            return False
    return True


def shown(config: FacetConfig, selected: dict[str, tuple[str, ...]], custom: dict[str, str] | None = None) -> bool:
    return not config.dependencies or any(dependency_met(d, selected, custom) for d in config.dependencies)


def order_facets(facets: list[dict], configs: dict[str, FacetConfig], most: int, filtered: set[str] = frozenset()) -> list[dict]:
    """By configured order, filtered ones first, then by coverage; cut at ``most`` plus those outside the limit."""
    ranked = sorted(facets, key=lambda f: (configs.get(f["name"], FacetConfig(f["name"])).order, f["name"] not in filtered, -f["coverage"], f["name"]))
    outside = sum(configs.get(f["name"], FacetConfig(f["name"])).exclude_from_limit for f in ranked)
    return ranked[: most + outside]


def human_key(text: str) -> tuple:
    m = re.search(r"\d+(\.\d+)?", text)
    return (0, float(m[0]), text) if m else (1, 0.0, text)


def entry_order(value_order: str) -> list[Column]:
    """Order of a facet's entries: COUNT, ALPHANUM or HUMAN_NUMERIC, with ``_DESC``."""
    number = F.regexp_extract("value", r"(\d+)", 1).try_cast("int")
    orders = {
        "COUNT": [F.col("doc_count").desc(), F.col("value")], "ALPHANUM_ASC": [F.col("value")], "ALPHANUM_DESC": [F.col("value").desc()],
        "HUMAN_NUMERIC_ASC": [number.asc_nulls_last(), F.col("value")], "HUMAN_NUMERIC_DESC": [number.desc_nulls_last(), F.col("value").desc()],
    }
    return orders[value_order]


def interval_label(low: float, high: float, unit: str = "", decimals: int = 0) -> str:
    a, b = (f"{x:.{decimals}f}" for x in (low, high))
    return f"{a} - {b}{' ' + unit if unit else ''}"


def field_stats(values: DataFrame, exact: bool = False) -> DataFrame:
    """Names with the number of their values, approximate (1 %) unless asked."""
    n = F.countDistinct("value") if exact else F.approx_count_distinct("value", 0.01)
    return values.groupBy("kind", "name").agg(n.alias("cardinality"))


def value_sketches(values: DataFrame, *by: str, precision: int = 12) -> DataFrame:
    """A sketch of the distinct values of each field, of a fixed size (4 KB at precision 12), to be stored."""
    return values.groupBy(*by, "kind", "name").agg(F.hll_sketch_agg("value", precision).alias("sketch"))


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """The number of values of each field from stored sketches, those of several versions put together."""
    return sketches.groupBy("kind", "name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality"))

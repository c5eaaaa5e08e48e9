"""Queries of filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..schema import Field, FieldIndex
from ..sources import catalog as C
from . import params
from .params import Filter
from .registry import query

FIELDS = FieldIndex([
    Field("brand", usage=("FACET", "FILTER", "RESULT")), Field("type", usage=("FACET", "FILTER")), Field("size", "NUMBER", usage=("FACET", "SORT")),
    Field("price", "NUMBER", "BOTH", usage=("FACET", "SORT", "SCORE")), Field("category", "CATEGORY", usage=("FACET",)), Field("color", level="VARIANT", usage=("FACET",)),
    Field("status", level="VARIANT", usage=("FACET",)), Field("variant_price", "NUMBER", "VARIANT", usage=("FACET",)), Field("title", usage=("SEARCH", "SORT")), Field("image", usage=("RESULT",)),
])


def both(spark, d, numbered=False):
    items, variants = C.items(spark, d), C.variants(spark, d, numbered)
    return items, (C.facet_values(items, variants) if numbered else C.facet_values(items))


def _sql(where: str) -> str:
    return f"WITH {C.SQL} SELECT i.doc_id, title FROM items i WHERE {where}"


def _has(cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM fv WHERE fv.doc_id = i.doc_id AND {cond})"


#: Columns that hold a field's values.
MASTER = {"brand": ["brand"], "type": ["type"], "size": ["size"], "price": ["price"], "category": ["type", "path"]}
CHILD = {"color": ["color"], "status": ["status"], "variant_price": ["price"]}


def _run(spark, d, *filters):
    variants = C.variants(spark, d, False) if any(f.level == "VARIANT" for f in filters) else None
    return P.filter_products(C.items(spark, d), list(filters), MASTER, variants, CHILD).select("doc_id", "title")


@query("flt_term", _sql("brand IN ('Brand#11', 'Brand#12', 'Brand#13')"))
def flt_term(spark, d):
    return _run(spark, d, Filter("brand", values=("brand#11", "brand#12", "brand#13")))


@query("flt_range", _sql("size BETWEEN 10 AND 20"))
def flt_range(spark, d):
    return _run(spark, d, Filter("size", "number", low=10, high=20))


@query("flt_path", _sql(_has("name = 'category' AND value_norm IN (SELECT lower(min(type)) FROM items)")))
def flt_path(spark, d):
    first = C.items(spark, d).agg(F.lower(F.min("type"))).first()[0]
    return _run(spark, d, Filter("category", "path", (first,)))


@query("flt_id", f"WITH {C.SQL} SELECT i.doc_id, title FROM items i WHERE size % 5 = 2")
def flt_id(spark, d):
    items = C.items(spark, d)
    ids = items.select("doc_id", F.lit(None).cast("int").alias("variant_pos"), F.lit("size").alias("name"), F.concat(F.lit("id"), (F.col("size") % 5).cast("string")).alias("value_id"))
    return P.apply_filter(items, ids, Filter("size", "id", ("id2",))).select("doc_id", "title")


@query("flt_negate", _sql("brand NOT IN ('Brand#11', 'Brand#12') AND size BETWEEN 1 AND 30"))
def flt_negate(spark, d):
    return _run(spark, d, Filter("brand", values=("brand#11", "brand#12"), negate=True), Filter("size", "number", low=1, high=30))


_BOTH = "((name = 'price' OR name = 'variant_price') AND num_value BETWEEN 905 AND 950)"


@query("flt_both_level", _sql(f"{_has(_BOTH)}"))
def flt_both_level(spark, d):
    items, fv = both(spark, d, True)
    prices = fv.withColumn("name", F.when(F.col("name") == "variant_price", F.lit("price")).otherwise(F.col("name")))
    return P.apply_filter(items, prices, Filter("price", "number", low=905, high=950, level="BOTH")).select("doc_id", "title")


@query("flt_nested", _sql("brand = 'Brand#21'"))
def flt_nested(spark, d):
    items, fv = both(spark, d)  # name and value of one entry
    return P.apply_filters(items, fv, [Filter("brand", values=("brand#21",))]).select("doc_id", "title")


@query("flt_variant", _sql("EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = i.doc_id AND color = 'R' AND status = 'O' AND v.price <= 920)"))
def flt_variant(spark, d):
    return _run(spark, d, Filter("color", values=("r",), level="VARIANT"), Filter("status", values=("o",), level="VARIANT"), Filter("variant_price", "number", high=920, level="VARIANT"))


@query("flt_merge_same", _sql("brand IN ('Brand#11', 'Brand#12') AND size BETWEEN 5 AND 20"))
def flt_merge_same(spark, d):
    return _run(
        spark, d, Filter("brand", values=("brand#11",)), Filter("brand", values=("brand#12",)), Filter("brand", values=("brand#31",), negate=True),
        Filter("size", "number", low=5, high=10), Filter("size", "number", low=8, high=20),
    )


@query("flt_parse", _sql("brand IN ('Brand#11', 'Brand#12') AND size BETWEEN 10 AND 20 AND NOT type = (SELECT min(type) FROM items)"))
def flt_parse(spark, d):
    first = C.items(spark, d).agg(F.min("type")).first()[0]
    got = params.parse_filters({"brand": "Brand#11,Brand#12", "size": "20,10", "type": f"!{first}", "unknown": "x", "image": "y", "price": "abc"}, FIELDS)
    return _run(spark, d, *got)


@query("flt_basic_vs_post", f"WITH {C.SQL} SELECT 'all' AS part, count(*) AS n FROM items WHERE size BETWEEN 1 AND 25 UNION ALL SELECT 'hits', count(*) FROM items WHERE size BETWEEN 1 AND 25 AND brand IN ('Brand#11', 'Brand#12')")
def flt_basic_vs_post(spark, d):
    filters = [Filter("brand", values=("brand#11", "brand#12")), Filter("size", "number", low=1, high=25)]
    basic, post = P.split_filters(filters, {"brand": {"multi_select": True}})
    items, fv = both(spark, d)
    aggregated = P.apply_filters(items, fv, basic)
    hits = P.apply_filters(aggregated, fv, post)
    return aggregated.agg(F.lit("all").alias("part"), F.count(F.lit(1)).alias("n")).union(hits.agg(F.lit("hits"), F.count(F.lit(1))))


@query("flt_query_condition", "SELECT item_id, CASE WHEN regexp_matches(text, '[0-9]') AND length(text) <= 200 THEN 'code' WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 20 THEN 'short' ELSE 'long' END AS strategy FROM benchmark")
def flt_query_condition(spark, d):
    from .params import QueryCondition, first_strategy

    strategies = [("code", QueryCondition("[0-9]", max_length=200)), ("short", QueryCondition(max_terms=20)), ("long", QueryCondition(min_terms=0))]
    return C.table(spark, d, "benchmark").select("item_id", first_strategy(F.col("text"), strategies).alias("strategy"))


@query("jn_parent_child_semi", _sql("EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = i.doc_id AND stock >= 49)"))
def jn_parent_child_semi(spark, d):
    return C.items(spark, d).join(P.same_variant(C.variants(spark, d, False), F.col("stock") >= 49), "doc_id", "left_semi").select("doc_id", "title")


@query("jn_parent_child_anti", _sql("NOT EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = i.doc_id AND stock >= 49)"))
def jn_parent_child_anti(spark, d):
    return C.items(spark, d).join(P.same_variant(C.variants(spark, d, False), F.col("stock") >= 49), "doc_id", "left_anti").select("doc_id", "title")


_TOP2 = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stock DESC, variant_pos) AS rank FROM variants WHERE color = 'R'"


@query("jn_inner_hits", f"WITH {C.SQL} SELECT i.doc_id, v.variant_pos, v.stock FROM items i LEFT JOIN (SELECT * FROM ({_TOP2}) WHERE rank <= 2) v ON v.doc_id = i.doc_id")
def jn_inner_hits(spark, d):
    top = P.top_variants(C.variants(spark, d).filter("color = 'R'"), [F.col("stock").desc()])
    return C.items(spark, d).select("doc_id").join(top, "doc_id", "left").select("doc_id", "variant_pos", "stock")


@query("top_inner_hits", f"WITH {C.SQL} SELECT doc_id, variant_pos, CAST(rank AS INTEGER) AS rank FROM ({_TOP2}) WHERE rank <= 2")
def top_inner_hits(spark, d):
    return P.top_variants(C.variants(spark, d).filter("color = 'R'"), [F.col("stock").desc()]).select("doc_id", "variant_pos", "rank")


@query("jn_variant_avg_score", f"WITH {C.SQL} SELECT i.doc_id, coalesce(round(s, 6), 0.0) AS score FROM items i LEFT JOIN (SELECT doc_id, sum(stock) / count(*) AS s FROM variants WHERE color = 'A' GROUP BY doc_id) v ON v.doc_id = i.doc_id")
def jn_variant_avg_score(spark, d):
    avg = C.variants(spark, d, False).filter("color = 'A'").groupBy("doc_id").agg(F.round(F.avg("stock"), 6).alias("s"))
    return C.items(spark, d).join(avg, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("score"))


_IDS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)"


@query("jn_id_list_ordered", f"WITH ids AS ({_IDS}) SELECT o.o_orderkey, CAST(pos AS INTEGER) AS pos, o_totalprice FROM orders o JOIN ids USING (o_orderkey)")
def jn_id_list_ordered(spark, d):
    orders = C.table(spark, d, "orders")
    one = orders.agg(F.min("o_custkey")).first()[0]
    # The list is a request's: a customer's order ids, in order.
    ids = orders.filter(F.col("o_custkey") == one).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("l"))
    listed = ids.select(F.posexplode("l").alias("pos", "e")).select("pos", F.col("e.o_orderkey").alias("k"))
    return orders.join(F.broadcast(listed), orders["o_orderkey"] == listed["k"]).select("o_orderkey", "pos", "o_totalprice")


_PATCH = "SELECT p_partkey AS k, 0 AS pos, p_retailprice AS p FROM part UNION ALL SELECT p_partkey, 999, p_retailprice * 2 FROM part"


@query("jn_patch", f"WITH {C.SQL}, u AS ({_PATCH}) SELECT coalesce(doc_id, k) AS doc_id, coalesce(variant_pos, pos) AS variant_pos, coalesce(p, price) AS price, color FROM variants FULL JOIN u ON k = doc_id AND pos = variant_pos")
def jn_patch(spark, d):
    items = C.items(spark, d)
    first = items.select(F.col("doc_id").alias("k"), F.lit(0).alias("pos"), F.col("price").alias("p"))
    updates = first.union(items.select("doc_id", F.lit(999), F.col("price") * 2))
    have = C.variants(spark, d)
    both_ = have.join(updates, (F.col("doc_id") == F.col("k")) & (F.col("variant_pos") == F.col("pos")), "full")
    return both_.select(F.coalesce("doc_id", "k").alias("doc_id"), F.coalesce("variant_pos", "pos").alias("variant_pos"), F.coalesce("p", have["price"]).alias("price"), "color")

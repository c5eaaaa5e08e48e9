"""Queries of aggregations and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as A
from ..operators import filters as P
from ..sources import catalog as C
from ..sources import scratch
from .params import Filter
from .registry import query


#: Products of a task in which values are counted.
PRODUCTS = 100_000


def _values(spark, d, *names, variants=False):
    # Products go by their ids before they are exploded, so many to a task: they are then counted
    # once in tasks of one size, without a shuffle of values, and not in the few that read a file.
    items = C.items(spark, d).select("doc_id", "brand", "type", "size", "price", "path")
    items = items.repartition(max(spark.sparkContext.defaultParallelism, -(-C.table(spark, d, "part").count() // PRODUCTS)), "doc_id")
    fv = C.facet_values(items, C.variants(spark, d) if variants else None)
    return fv.filter(F.col("name").isin(*names)) if names else fv


_W = f"WITH {C.SQL} "


@query("entry_brand_facet", _W + "SELECT brand AS value, count(*) AS doc_count FROM items WHERE size BETWEEN 10 AND 20 GROUP BY brand")
def entry_brand_facet(spark, d):
    kept = P.filter_products(C.items(spark, d), [Filter("size", "number", low=10, high=20)], {"size": ["size"]})
    return A.term_facet(C.facet_values(kept).filter("name = 'brand'")).select("value", "doc_count")


_TERM = """, raw AS (SELECT name, value, value_norm, count(DISTINCT doc_id) AS n FROM fv WHERE {w} GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS r FROM raw)
 SELECT name, arg_max(value, (n, value)) AS value, CAST(sum(n) AS BIGINT) AS doc_count FROM top WHERE r <= 100 GROUP BY name, value_norm"""


@query("agg_term_facet", _W + _TERM.format(w="kind = 'term' AND variant_pos IS NULL"))
def agg_term_facet(spark, d):
    return A.term_facet(_values(spark, d, "brand", "type"))


@query("agg_variant_facet", _W + _TERM.format(w="kind = 'term' AND variant_pos IS NOT NULL"))
def agg_variant_facet(spark, d):
    return A.term_facet(P.level_rows(_values(spark, d, "color", "status", variants=True), "VARIANT"))


_FIRST = "(SELECT min(path) FROM items)"


@query("agg_category_facet", _W + f", n AS (SELECT value AS path, count(DISTINCT doc_id) AS doc_count FROM fv WHERE kind = 'path' GROUP BY value QUALIFY row_number() OVER (ORDER BY doc_count DESC, path) <= 250 OR value = {_FIRST} OR value = split_part({_FIRST}, '/', 1)), k AS (SELECT * FROM n WHERE path = {_FIRST} OR {_FIRST} LIKE path || '/%') SELECT path, md5(path) AS id, CAST(len(string_split(path, '/')) AS INTEGER) AS level, doc_count, path = {_FIRST} AS selected FROM k")
def agg_category_facet(spark, d):
    first = C.items(spark, d).agg(F.min("path")).first()[0]
    values = _values(spark, d, "category").withColumn("value_id", F.md5("value"))
    tree = A.category_tree(values, (first.lower(),), keep=(first,))
    return spark.createDataFrame([(e["path"], e["id"], e["path"].count("/") + 1, e["doc_count"], e["selected"]) for e in A.flat(tree)], "path string, id string, level int, doc_count long, selected boolean")


@query("agg_interval_facet")
def agg_interval_facet(spark, d):
    return A.merge_intervals(A.histogram(_values(spark, d, "size")))


@query("agg_interval_n", _W + "SELECT name, floor(num_value / 100) * 100 AS lower, count(DISTINCT doc_id) AS doc_count FROM fv WHERE name = 'price' GROUP BY ALL")
def agg_interval_n(spark, d):
    return A.histogram(_values(spark, d, "price"), 100.0)


@query("agg_fixed_ranges", _W + "SELECT 'price' AS name, CASE WHEN price < 950 THEN 'low' WHEN price < 1200 THEN 'mid' ELSE 'high' END AS label, count(*) AS doc_count FROM items GROUP BY ALL")
def agg_fixed_ranges(spark, d):
    return A.fixed_ranges(_values(spark, d, "price"), [(None, 950, "low"), (950, 1200, "mid"), (1200, None, "high")])


@query("agg_range_facet", _W + "SELECT name, ceil(min(num_value) * 100 - 0.5) / 100 AS lower, floor(max(num_value) * 100 + 0.5) / 100 AS upper, count(*) AS doc_count FROM fv WHERE kind = 'number' AND variant_pos IS NULL GROUP BY name HAVING min(num_value) <> max(num_value)")
def agg_range_facet(spark, d):
    return A.range_facet(_values(spark, d, "size", "price"))


@query("agg_index_facet", "SELECT 'part' AS _index, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def agg_index_facet(spark, d):
    a = C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("part").alias("_index"))
    b = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("supplier").alias("_index"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("_index").agg(F.count(F.lit(1)).alias("n"))


@query("agg_parent_count", _W + "SELECT color AS value, count(*) AS entries, count(DISTINCT doc_id) AS doc_count FROM variants GROUP BY color")
def agg_parent_count(spark, d):
    v = C.variants(spark, d, False)
    # Two levels: entries per product first, so that the second only counts rows.
    per = v.groupBy("color", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("color").alias("value")).agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("doc_count"))


@query("agg_custom_facet", _W + "SELECT 'size' AS name, CASE WHEN num_value % 2 = 0 THEN 'even' ELSE 'odd' END AS value, count(DISTINCT doc_id) AS doc_count FROM fv WHERE name = 'size' GROUP BY ALL")
def agg_custom_facet(spark, d):
    from .extensions import Registry

    registry = Registry()
    registry.add("facet", "parity", lambda v: v.withColumn("value", F.when(F.col("num_value") % 2 == 0, "even").otherwise("odd")).groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count")))
    return registry.get("facet", "parity")(_values(spark, d, "size"))


_SEL = "m AS (SELECT doc_id, brand IN ('Brand#11','Brand#12','Brand#13') AS sb, size <= 25 AS ss FROM items)"


@query("agg_exclusive", _W + f", {_SEL} SELECT name, value, count(DISTINCT fv.doc_id) AS doc_count FROM fv JOIN m USING (doc_id) WHERE variant_pos IS NULL AND name IN ('brand','type','size') AND (sb OR name = 'brand') AND (ss OR name = 'size') GROUP BY ALL")
def agg_exclusive(spark, d):
    items = C.items(spark, d)
    values = C.facet_values(items).filter(F.col("name").isin("brand", "type", "size"))
    sel = {"brand": F.col("value_norm").isin("brand#11", "brand#12", "brand#13"), "size": F.col("num_value") <= 25}
    return A.exclusive_facets(values, sel, A.selection_marks(items, values, sel))


_BOTH = """, p AS (SELECT doc_id, brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AS b, size <= 40 AS z FROM items),
w AS (SELECT doc_id, variant_pos, color, status, price, color = 'R' AS c, status = 'F' AS s, price >= 1200 AS q FROM variants),
r AS (SELECT doc_id, bool_or(c AND s AND q) AS whole FROM w GROUP BY doc_id),
e AS (
  SELECT name, value, fv.doc_id FROM fv JOIN p ON p.doc_id = fv.doc_id JOIN r ON r.doc_id = fv.doc_id WHERE variant_pos IS NULL AND name IN ('brand', 'type', 'size') AND whole AND (b OR name = 'brand') AND (z OR name = 'size')
  UNION ALL SELECT 'color', color, w.doc_id FROM w JOIN p ON p.doc_id = w.doc_id WHERE b AND z AND s AND q
  UNION ALL SELECT 'status', status, w.doc_id FROM w JOIN p ON p.doc_id = w.doc_id WHERE b AND z AND c AND q
  UNION ALL SELECT 'variant_price', CAST(price AS VARCHAR), w.doc_id FROM w JOIN p ON p.doc_id = w.doc_id WHERE b AND z AND c AND s)
SELECT name, value, count(DISTINCT doc_id) AS doc_count FROM e GROUP BY ALL"""


@query("agg_exclusive_variant", _W + _BOTH)
def agg_exclusive_variant(spark, d):
    """Color, status and price selected on variants, brand and size on products: each facet under all others, met by one variant."""
    values = C.facet_values(C.items(spark, d), C.variants(spark, d)).filter(F.col("name").isin("brand", "type", "size", "color", "status", "variant_price"))
    master = {"brand": F.col("value_norm").isin("brand#11", "brand#12", "brand#13", "brand#21"), "size": F.col("num_value") <= 40}
    variant = {"color": F.col("value_norm") == "r", "status": F.col("value_norm") == "f", "variant_price": F.col("num_value") >= 1200}
    return A.exclusive_facets_on_variants(values, master, variant)


@query("agg_filter_sensitive", _W + "SELECT name, value, count(DISTINCT doc_id) AS doc_count FROM fv WHERE name = 'brand' AND value_norm IN ('brand#11','brand#12') GROUP BY ALL")
def agg_filter_sensitive(spark, d):
    own = _values(spark, d, "brand").filter(P.condition(Filter("brand", values=("brand#11", "brand#12"))))
    return own.groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count"))


@query("agg_sampling", _W + ", s AS (SELECT * FROM items ORDER BY price DESC, doc_id LIMIT 200) SELECT brand AS value, count(*) AS doc_count FROM s GROUP BY brand")
def agg_sampling(spark, d):
    top = C.items(spark, d).orderBy(F.col("price").desc(), "doc_id").limit(200)  # the feature: facets of the best hits only
    return top.groupBy(F.col("brand").alias("value")).agg(F.count(F.lit(1)).alias("doc_count"))


@query("agg_names_limit", _W + "SELECT name, n FROM (SELECT name, count(DISTINCT doc_id) AS n, dense_rank() OVER (ORDER BY count(DISTINCT doc_id) DESC, name) AS r FROM fv GROUP BY name) WHERE r <= 3 OR name = 'status'")
def agg_names_limit(spark, d):
    from pyspark.sql import Window

    n = _values(spark, d, variants=True).groupBy("name").agg(F.countDistinct("doc_id").alias("n"))
    rank = F.dense_rank().over(Window.orderBy(F.col("n").desc(), "name"))
    return n.withColumn("r", rank).filter("r <= 3 OR name = 'status'").drop("r")


@query("agg_merge_levels", _W + ", e AS (SELECT 'price' AS name, floor(num_value / 100) AS value, variant_pos IS NULL AS m, count(DISTINCT doc_id) AS n FROM fv WHERE name IN ('price','variant_price') GROUP BY ALL) SELECT name, CAST(value AS BIGINT) AS value, max(n) AS doc_count FROM e GROUP BY name, value")
def agg_merge_levels(spark, d):
    v = _values(spark, d, "price", "variant_price", variants=True)
    per = v.groupBy(F.lit("price").alias("name"), F.floor(F.col("num_value") / 100).alias("value"), F.col("variant_pos").isNull().alias("m")).agg(F.countDistinct("doc_id").alias("doc_count"))
    return A.merge_levels(per)


@query("agg_default_type", _W + "SELECT name, CASE kind WHEN 'number' THEN 'interval' WHEN 'path' THEN 'hierarchical' ELSE 'term' END AS facet_type, count(DISTINCT doc_id) AS doc_count, count(DISTINCT CASE WHEN kind = 'number' THEN CAST(floor(num_value / 5) * 5 AS VARCHAR) WHEN kind = 'path' THEN split_part(value, '/', 1) ELSE value END) AS entries FROM fv WHERE variant_pos IS NULL GROUP BY ALL")
def agg_default_type(spark, d):
    """All fields as facets of their types' default kinds: terms, intervals, or a tree's top level."""
    kinds = {k: A.default_type(t) for k, t in (("term", "STRING"), ("number", "NUMBER"), ("path", "CATEGORY"))}
    facet_type = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()])
    low = (F.floor(F.col("num_value") / A.INTERVAL) * A.INTERVAL).cast("string")
    entry = F.when(facet_type == "interval", low).when(facet_type == "hierarchical", F.substring_index("value", "/", 1)).otherwise(F.col("value"))
    return _values(spark, d).groupBy("name", facet_type.alias("facet_type")).agg(F.countDistinct("doc_id").alias("doc_count"), F.countDistinct(entry).alias("entries"))


_COV = ", c AS (SELECT name, CAST(sum(n) AS BIGINT) AS coverage, count(*) AS entries FROM (SELECT name, value, count(DISTINCT doc_id) AS n FROM fv WHERE variant_pos IS NULL GROUP BY ALL) GROUP BY name)"


def _stats(spark, d):
    return A.coverage(_values(spark, d).groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count")))


@query("agg_cov_filter", _W + _COV + " SELECT * FROM c WHERE coverage >= 1.5 * (SELECT count(*) FROM items)")
def agg_cov_filter(spark, d):
    n = C.items(spark, d).count()
    names = ("brand", "type", "size", "price", "category")
    return A.visible(_stats(spark, d), n, {x: A.FacetConfig(x, min_coverage=1.5) for x in names}, set())


@query("agg_size_filter", _W + _COV + " SELECT * FROM c WHERE entries >= 20 OR name = 'type'")
def agg_size_filter(spark, d):
    n = C.items(spark, d).count()
    names = ("brand", "type", "size", "price", "category")
    return A.visible(_stats(spark, d), n, {x: A.FacetConfig(x, min_value_count=20) for x in names}, {"type"})


@query("agg_dep_filter", _W + "SELECT name, value, count(DISTINCT doc_id) AS doc_count FROM fv WHERE variant_pos IS NULL AND name IN ('size', 'type') AND doc_id IN (SELECT doc_id FROM items WHERE brand = 'Brand#11') GROUP BY ALL")
def agg_dep_filter(spark, d):
    """Facets of filtered products, of which one asks for a brand that isn't selected and one for a field without a filter."""
    selected = {"brand": ("brand#11",)}
    deps = {"size": ("brand=*",), "type": ("color=*", "brand=Brand#11"), "price": ("brand=Brand#12",), "category": ("brand=*&color=*",)}
    names = [n for n, some in deps.items() if A.shown(A.FacetConfig(n, dependencies=some), selected)]
    hits = C.items(spark, d).filter(F.lower("brand").isin(*selected["brand"]))
    return C.facet_values(hits).filter(F.col("name").isin(*names)).groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count"))


@query("agg_facet_order", _W + _COV + " SELECT name, coverage, row_number() OVER (ORDER BY name <> 'size', coverage DESC, name) AS pos FROM c QUALIFY pos <= 3")
def agg_facet_order(spark, d):
    rows = [r.asDict() for r in _stats(spark, d).collect()]  # one row per facet name
    ranked = A.order_facets(rows, {}, 3, {"size"})
    return spark.createDataFrame([(r["name"], r["coverage"], i + 1) for i, r in enumerate(ranked)], "name string, coverage long, pos long")


@query("agg_entry_order", _W + "SELECT value, doc_count, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(value, '(\\d+)', 1) AS INTEGER), value) AS pos FROM (SELECT brand AS value, count(*) AS doc_count FROM items GROUP BY brand)")
def agg_entry_order(spark, d):
    from pyspark.sql import Window

    t = A.term_facet(_values(spark, d, "brand")).select("value", "doc_count")
    return t.withColumn("pos", F.row_number().over(Window.orderBy(*A.entry_order("HUMAN_NUMERIC_ASC"))).cast("long"))


@query("agg_entry_label", _W + "SELECT lower, CAST(lower AS INTEGER) || ' - ' || CAST(lower + 10 AS INTEGER) || ' cm' AS label FROM (SELECT DISTINCT floor(size / 10) * 10 AS lower FROM items)")
def agg_entry_label(spark, d):
    low = A.histogram(_values(spark, d, "size"), 10.0).select("lower").distinct()
    return low.select("lower", F.format_string("%.0f - %.0f cm", "lower", F.col("lower") + 10).alias("label"))


@query("agg_field_stats", _W + "SELECT kind, name, count(DISTINCT value) AS cardinality FROM fv WHERE variant_pos IS NULL GROUP BY ALL")
def agg_field_stats(spark, d):
    return A.field_stats(_values(spark, d), exact=True)


@query("agg_field_sketches", _W + "SELECT kind, name, count(DISTINCT value) AS cardinality, true AS close FROM fv GROUP BY ALL")
def agg_field_sketches(spark, d):
    """Stored sketches of three versions of the values, put together; each estimate is within three times its standard error."""
    values = _values(spark, d, variants=True)
    stored = scratch.keep(A.value_sketches(values.withColumn("version", F.col("doc_id") % 3), "version"), "sketches")
    estimate, exact = A.sketched_stats(stored).withColumnRenamed("cardinality", "estimate"), A.field_stats(values, exact=True)
    error = F.greatest(F.col("cardinality") * (3 * 1.04 / 64), F.lit(1.0))
    return exact.join(estimate, ["kind", "name"]).select("kind", "name", "cardinality", (F.abs(F.col("estimate") - F.col("cardinality")) <= error).alias("close"))


@query("agg_total_hits", _W + "SELECT count(*) AS n FROM items WHERE brand = 'Brand#11' AND doc_id NOT IN (SELECT doc_id FROM items WHERE brand = 'Brand#11' ORDER BY doc_id LIMIT 3)")
def agg_total_hits(spark, d):
    hits = C.items(spark, d).filter("brand = 'Brand#11'")
    heroes = hits.orderBy("doc_id").limit(3).select("doc_id")
    return hits.join(heroes, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))

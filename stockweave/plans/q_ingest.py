"""Queries of sources, sinks, preprocessors, projections and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import preprocess as R
from ..operators import projections as J
from ..operators import store as K
from ..sources import catalog as C
from ..sources import scratch
from ..sources import documents as D
from .registry import query

_W = f"WITH {C.SQL} "


def docs(spark, d):
    """Parts as documents: data of string lists, attributes with and without code."""
    p = C.items(spark, d)
    data = F.create_map(
        F.lit("title"), F.array("title"), F.lit("brand"), F.array("brand"), F.lit("size"), F.array(F.col("size").cast("string")),
        F.lit("category"), F.array("path"), F.lit("tags"), F.array(F.col("title"), F.lower("brand"), F.col("title")),
    )
    attribute = lambda n, c, v: F.struct(F.lit(n).alias("name"), c.cast("string").alias("code"), v.cast("string").alias("value"))
    attributes = F.array(attribute("color", F.lit(None), F.col("type")), attribute("color", F.lit(None), F.lit("black")), attribute("width", F.col("size"), F.col("size")))
    return p.select("doc_id", data.alias("data"), attributes.alias("attributes"))


def _values(df, *names):
    return df.select("doc_id", *[F.array_join(F.element_at("data", n), "|").alias(n) for n in names])


# --- sources -----------------------------------------------------------------


@query("src_table_scan", "SELECT p_partkey, p_name FROM part")
def src_table_scan(spark, d):
    return C.table(spark, d, "part").select("p_partkey", "p_name")


@query("src_multi_index", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, 'part' AS _index FROM part UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def src_multi_index(spark, d):
    a = C.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.lit("part").alias("_index"))
    b = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("_index"))
    return a.unionByName(b, allowMissingColumns=True)


@query("src_point_get", "SELECT p_partkey AS doc_id, p_name FROM part WHERE p_partkey = 7")
def src_point_get(spark, d):
    return D.point_get(C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), 7)


@query("src_unmap_document", "SELECT p_partkey AS doc_id, p_name AS title, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part")
def src_unmap_document(spark, d):
    p = C.items(spark, d)
    indexed = p.select(
        "doc_id", F.create_map(F.lit("title"), F.col("title")).alias("result"), F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("title"), F.lit("later")).alias("facets"),
        F.create_map(F.lit("brand"), F.col("brand"), F.lit("size"), F.lit("0")).alias("search"),
    )
    out = D.original_form(indexed, ["result", "facets", "search"])
    return out.select("doc_id", *[F.element_at("data", n).alias(n) for n in ("title", "size", "brand")])


@query("src_json_docs", "SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(1 AS INTEGER) AS n FROM events")
def src_json_docs(spark, d):
    v = D.values_of(F.col("props"), "$.k")
    return C.table(spark, d, "events").select("event_id", F.get(v, F.lit(0)).alias("v"), F.size(v).alias("n"))


#: The values of an event as a document: key, kind, texts, in DuckDB's terms.
_TYPED = {
    "k": ("int", "json_extract_string(props, '$.k')"),
    "id": ("long", "CAST(5000000000 + event_id AS VARCHAR)"),
    "value": ("double", "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5'"),
    "type": ("string", "event_type"),
    "cut": ("int[]", "CAST(user_id AS VARCHAR) || ',2,-3'"),
    "names": ("string[]", "event_type || ',3,true,1.5'"),
    "doubles": ("double[]", "'0.5,1.25'"),
    "grid": ("int[][]", "'1,2;' || CAST(event_id % 7 AS VARCHAR)"),
    "category": ("path", "'c' || CAST(event_id % 7 AS VARCHAR) || ':' || event_type || '>-:leaf'"),
    "trees": ("path[]", "'-:a>-:b;7:' || event_type"),
    "color": ("attribute", "'color/' || CAST(event_id % 7 AS VARCHAR) || '/' || event_type"),
    "gone": ("null", "''"),
}


@query("src_json_typed", "SELECT event_id, key, kind, said FROM events, LATERAL (VALUES " + ", ".join(f"('{k}', '{kind}', {said})" for k, (kind, said) in _TYPED.items()) + ") t(key, kind, said)")
def src_json_typed(spark, d):
    """Documents of mixed types, made of each event: values keep their types, lists that of their first element."""
    e, text = C.table(spark, d, "events"), F.col("event_type")
    quoted, seventh = F.concat(F.lit('"'), text, F.lit('"')), (F.col("event_id") % 7).cast("string")
    json = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "id": '), (F.col("event_id") + 5_000_000_000).cast("string"), F.lit(', "value": '), F.floor("value").cast("string"), F.lit('.5, "type": '), quoted,
        F.lit(', "cut": ['), F.col("user_id").cast("string"), F.lit(', 2.7, "x", null, -3.2, 6000000000], "names": ['), quoted, F.lit(', 3, true, 1.5, {"deep": 1}], "doubles": [0.5, 2, "x", 1.25], "grid": [[1, 2], ["x"], ['), seventh,
        F.lit(']], "category": [{"id": "c'), seventh, F.lit('", "name": '), quoted, F.lit('}, {"name": "leaf"}, {"id": "nameless"}, 5], "trees": [[{"name": "a"}, {"name": "b"}], [1], [{"id": 7, "name": '), quoted,
        F.lit('}]], "color": {"name": "color", "code": "'), seventh, F.lit('", "value": '), quoted, F.lit('}, "gone": null, "none": {}, "empty": [], "deep": [[[1]]]}'),
    )
    values = e.select("event_id", F.explode(D.properties(json)).alias("key", "v"))
    rows = values.select("event_id", "key", F.inline(D.typed_values(F.col("v")))).filter("kind IS NOT NULL")
    lists = F.array_join(F.transform("texts", lambda t: F.array_join(t, ",")), ";")
    paths = F.array_join(F.transform("paths", lambda p: F.array_join(F.transform(p, lambda c: F.concat(F.coalesce(c["id"], F.lit("-")), F.lit(":"), c["name"])), ">")), ";")
    own = F.concat_ws("/", "attribute.name", "attribute.code", "attribute.value")
    return rows.select("event_id", "key", "kind", F.concat(lists, paths, own).alias("said"))


def _lines(spark, d, folder):
    p = C.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.create_map(F.lit("title"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("data"), F.lit(1).alias("unknown"))
    p.write.mode("overwrite").json(folder)
    return folder


@query("src_jsonl", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS brand FROM part")
def src_jsonl(spark, d):
    read = D.read_json(spark, _lines(spark, d, scratch.folder(spark, "jsonl")))
    return read.select("id", F.element_at("data", "title").alias("title"), F.element_at("data", "brand").alias("brand"))


@query("src_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS VARCHAR) AS size FROM part")
def src_csv(spark, d):
    folder = scratch.folder(spark, "csv")
    C.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("size")).write.option("header", True).option("sep", ";").csv(folder)
    read = D.read_csv(spark, folder, "p_partkey", ";")
    return read.select("id", F.element_at("data", "title").alias("title"), F.element_at("data", "size").alias("size"))


# --- sinks -------------------------------------------------------------------


@query("snk_deploy", "SELECT count(*) AS n, 2 AS live, 'parts-en' AS tenants FROM part WHERE p_size <= 25")
def snk_deploy(spark, d):
    store = K.Store(spark, scratch.folder(spark, "store"))
    one = store.start("parts", "EN")
    store.add(one, C.items(spark, d))
    store.deploy(one)
    two = store.start("parts", "en")
    store.add(two, C.items(spark, d).filter("size <= 25"))
    too_small = store.start("parts", "en")
    store.add(too_small, C.items(spark, d).filter("size < 0"))
    assert store.deploy(two) and not store.deploy(two) and not store.deploy(too_small)
    store.cancel(too_small)
    return store.read("parts-en").agg(F.count(F.lit(1)).alias("n"), F.lit(store.live("parts-en")).alias("live"), F.lit(",".join(store.tenants())).alias("tenants"))


@query("snk_bulk_add", "SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE TRY_CAST(left(o_orderpriority, 2) AS DOUBLE) IS NULL) AS rejected FROM part")
def snk_bulk_add(spark, d):
    store = K.Store(spark, scratch.folder(spark, "bulk"))
    s = store.start("parts", "en")
    for part in (C.items(spark, d).filter("size <= 25"), C.items(spark, d).filter("size > 25")):
        store.add(s, part)
    store.deploy(s)
    bad = J.rejects(C.table(spark, d, "orders"), F.substring("o_orderpriority", 1, 2)).agg(F.count(F.lit(1)).alias("rejected"))
    return store.read("parts-en").agg(F.count(F.lit(1)).alias("n")).crossJoin(bad)  # one row by one row


_CHANGES = "SELECT event_id, user_id AS doc_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'put' END AS op, value FROM events"


def _changes(spark, d):
    e = C.table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    return e.select("event_id", F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == first, "delete").otherwise("put").alias("op"), "value")


def _last(changes):
    return changes.groupBy("doc_id").agg(F.max_by(F.struct("op", "value"), "event_id").alias("c")).select("doc_id", "c.op", "c.value")


_LAST = f"SELECT doc_id, arg_max(op, event_id) AS op, arg_max(value, event_id) AS value FROM ({_CHANGES}) GROUP BY doc_id"


@query("snk_put", f"SELECT coalesce(doc_id, p_partkey) AS doc_id, CASE WHEN doc_id IS NULL THEN p_retailprice ELSE value END AS value FROM part FULL JOIN (SELECT * FROM ({_LAST}) WHERE op = 'put') ON doc_id = p_partkey")
def snk_put(spark, d):
    have = C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("value"))
    return K.put(have, _last(_changes(spark, d)).filter("op = 'put'").select("doc_id", "value"))


@query("snk_delete", f"SELECT p_partkey AS doc_id, p_name FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM ({_LAST}) WHERE op = 'delete')")
def snk_delete(spark, d):
    have = C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return K.delete(have, _last(_changes(spark, d)).filter("op = 'delete'"))


@query("snk_patch", f"SELECT p_partkey AS doc_id, p_name AS title, CASE WHEN value IS NULL THEN 'old' ELSE 'new' END AS state FROM part LEFT JOIN (SELECT * FROM ({_LAST}) WHERE op = 'put') ON doc_id = p_partkey")
def snk_patch(spark, d):
    """Patches of known documents; the code of an unknown id is NOT_FOUND, and nothing is made of it."""
    have = C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.create_map(F.lit("title"), F.col("p_name"), F.lit("state"), F.lit("old")).alias("data"))
    up = _changes(spark, d).groupBy("doc_id").agg(F.max_by("op", "event_id").alias("op")).filter("op = 'put'").select("doc_id", F.create_map(F.lit("state"), F.lit("new")).alias("data"))
    parts = {"attributes": J.F_ATTRIBUTES, "categories": "array<array<string>>", "variants": f"array<struct<data:map<string,string>,attributes:{J.F_ATTRIBUTES}>>"}
    whole = lambda x: x.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in parts.items()])
    return J.patch_documents(whole(have), whole(up)).select("doc_id", F.element_at("data", "title").alias("title"), F.element_at("data", "state").alias("state"))


@query("snk_result_codes", f"SELECT doc_id, CASE WHEN op = 'delete' THEN CASE WHEN p_partkey IS NULL THEN 'NOT_FOUND' ELSE 'DELETED' END ELSE CASE WHEN p_partkey IS NULL THEN 'CREATED' ELSE 'UPDATED' END END AS result FROM ({_LAST}) LEFT JOIN part ON p_partkey = doc_id")
def snk_result_codes(spark, d):
    return K.result_codes(C.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id")), _last(_changes(spark, d)))


@query("snk_stream_upsert", f"SELECT doc_id, value FROM ({_LAST}) WHERE op = 'put'")
def snk_stream_upsert(spark, d):
    from ..streaming.updates import replay

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    first = C.table(spark, d, "events").agg(F.min("event_type")).first()[0]
    source = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    op = F.when(F.col("event_type") == first, "delete").otherwise("put")
    return replay(source.select("event_id", F.col("user_id").alias("doc_id"), op.alias("op"), "value"), scratch.folder(spark, "stream"))


# --- preprocessors -----------------------------------------------------------


@query("pre_asciify", f"SELECT doc_id, md5(translate(text, '{S.FOLD_FROM}', '{S.FOLD_TO}')) AS v FROM documents")
def pre_asciify(spark, d):
    x = C.table(spark, d, "documents").select("doc_id", F.create_map(F.lit("text"), F.array("text")).alias("data"))
    return R.ascii_fold(x, ["text"]).select("doc_id", F.md5(F.get(F.element_at("data", "text"), F.lit(0))).alias("v"))


@query("pre_attr_to_field", _W + "SELECT doc_id, CASE WHEN type = 'black' THEN 'black' ELSE type || '|black' END AS color, CAST(1 AS INTEGER) AS n FROM items")
def pre_attr_to_field(spark, d):
    out = R.attributes_to_fields(docs(spark, d))
    return out.select("doc_id", F.array_join(F.element_at("data", "color"), "|").alias("color"), F.size("attributes").alias("n"))


@query("pre_category_levels", _W + "SELECT doc_id, type AS category_lvl_0, split_part(path, '/', 2) AS category_lvl_1, split_part(path, '/', 2) AS category_leaf FROM items")
def pre_category_levels(spark, d):
    return _values(R.category_levels(docs(spark, d), "category", 2), "category_lvl_0", "category_lvl_1", "category_leaf")


@query("pre_flag", _W + "SELECT doc_id, CASE WHEN regexp_matches(title, '^[a-c]') OR regexp_matches(title, 'e$') THEN 'x' WHEN regexp_matches(title, 'o') THEN 'y' ELSE 'none' END AS flag FROM items")
def pre_flag(spark, d):
    return _values(R.flag_field(docs(spark, d), "title", "flag", [("^[a-c]##e$", "x"), ("o", "y")], "none"), "flag")


@query("pre_remove_values", _W + "SELECT doc_id, array_to_string(list_filter(string_split_regex(title, '\\s+'), lambda t: NOT regexp_full_match(t, '[a-m].*')), ' ') AS title FROM items")
def pre_remove_values(spark, d):
    return _values(R.remove_values(docs(spark, d), "title", "[a-m].*"), "title")


@query("pre_replace_pattern", _W + "SELECT doc_id, regexp_replace(title, '[aeiou]', '', 'g') || '|' || regexp_replace(lower(brand), '[aeiou]', '', 'g') AS tags FROM items")
def pre_replace_pattern(spark, d):
    return _values(R.replace_pattern(docs(spark, d), "tags", "[aeiou]", ""), "tags")


@query("pre_skip_document", _W + "SELECT doc_id, title FROM items WHERE NOT regexp_full_match(brand, 'Brand#1.*')")
def pre_skip_document(spark, d):
    return _values(R.skip_documents(docs(spark, d), "brand", "Brand#1.*"), "title")


@query("pre_split_value", _W + "SELECT doc_id, split_part(title, ' ', 1) AS w_0, split_part(title, ' ', 2) AS w_1, CASE WHEN len(string_split(brand, '#')) = 2 THEN split_part(brand, '#', 2) END AS number FROM items")
def pre_split_value(spark, d):
    out = R.split_value(docs(spark, d), "title", " ", wildcard="w", parts=2, keep=False)
    return _values(R.split_value(out, "brand", "#", targets=["maker", "number"]), "w_0", "w_1", "number")


@query("pre_word_split")
def pre_word_split(spark, d):
    return _values(R.split_words(docs(spark, d), ["title"], "words", ["fuss", "ball", "steel", "bolt", "box", "copper"]), "words")


@query("pre_content_delimiter", _W + "SELECT doc_id, CASE WHEN split_part(title, ' ', 1) = split_part(title, ' ', 2) THEN split_part(title, ' ', 1) ELSE replace(title, ' ', '|') END AS title FROM items")
def pre_content_delimiter(spark, d):
    return _values(R.split_delimited(docs(spark, d), "title", " "), "title")


# --- projections -------------------------------------------------------------


@query("prj_search", _W + ", c AS (SELECT doc_id, string_agg(color, ' ' ORDER BY color) AS c FROM (SELECT DISTINCT doc_id, color FROM variants) GROUP BY doc_id) SELECT i.doc_id, 'product ' || title || ' ' || brand AS content, c.c AS color_content FROM items i LEFT JOIN c ON c.doc_id = i.doc_id")
def prj_search(spark, d):
    m = C.items(spark, d).select("doc_id", J.search_content(F.array("title", "brand"), "product").alias("content"))
    return J.with_variant_content(m, C.variants(spark, d, False), "color")


@query("prj_result", _W + "SELECT doc_id, title, CAST(size AS DOUBLE) AS size, path FROM items")
def prj_result(spark, d):
    return C.items(spark, d).select("doc_id", "title", S.parse_number(F.col("size")).alias("size"), "path")


@query("prj_sort", _W + "SELECT doc_id, min(p) AS lo, max(p) AS hi FROM (SELECT doc_id, price AS p FROM items UNION ALL SELECT doc_id, price FROM variants) GROUP BY doc_id")
def prj_sort(spark, d):
    rows = C.items(spark, d).select("doc_id", "price").union(C.variants(spark, d, False).select("doc_id", "price"))
    return J.sort_ends(rows, "doc_id", "price")


@query("prj_filter", _W + "SELECT doc_id, 'status' AS name, string_agg(status, '|' ORDER BY status) AS v FROM (SELECT DISTINCT doc_id, status FROM variants) GROUP BY doc_id")
def prj_filter(spark, d):
    from ..schema import Field

    # color is a facet, too: its facet entries are what it is filtered by.
    fields = [Field("status", level="VARIANT", usage=("FILTER",)), Field("color", level="VARIANT", usage=("FACET", "FILTER"))]
    return J.filter_entries(C.variants(spark, d, False), "doc_id", fields).select("doc_id", "name", F.array_join("values", "|").alias("v"))


@query("prj_term_facet", _W + "SELECT doc_id, coalesce(variant_pos, -1) AS pos, name, value, value_norm FROM fv WHERE kind = 'term'")
def prj_term_facet(spark, d):
    return C.facet_values(C.items(spark, d), C.variants(spark, d)).filter("kind = 'term'").select("doc_id", F.coalesce("variant_pos", F.lit(-1)).alias("pos"), "name", "value", "value_norm")


@query("prj_number_facet", "SELECT o_orderkey, 'prio' AS name, CAST(left(o_orderpriority, 1) AS DOUBLE) AS num_value FROM orders WHERE regexp_matches(left(o_orderpriority, 1), '^[0-9]$')")
def prj_number_facet(spark, d):
    return J.number_entries(C.table(spark, d, "orders"), "o_orderkey", "prio", F.substring("o_orderpriority", 1, 1))


@query("prj_path_facet", "SELECT s_suppkey, unnest([replace(r_name, '/', '%2F'), r_name || '/' || n_name, r_name || '/' || n_name || '/' || s_name]) AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def prj_path_facet(spark, d):
    # Nation and region are dimensions of fixed size.
    n = C.table(spark, d, "nation").join(F.broadcast(C.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = C.table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.explode(J.path_ancestors(F.array("r_name", "n_name", "s_name"))).alias("path"))


@query("prj_score", _W + "SELECT doc_id, max(stock) AS score FROM variants GROUP BY doc_id")
def prj_score(spark, d):
    return J.score_max(C.variants(spark, d, False), "doc_id", "stock")


@query("prj_post", _W + "SELECT doc_id, upper(title) AS title FROM items")
def prj_post(spark, d):
    from .extensions import Registry

    r = Registry()
    r.add("postprocessor", "shout", lambda df: df.withColumn("title", F.upper("title")))
    return r.get("postprocessor", "shout")(C.items(spark, d).select("doc_id", "title"))


def _whole(spark, d):
    """Parts as whole documents, and patches of some of them and of unknown ids."""
    text = lambda c: (F.lit(c) if isinstance(c, str) else c).cast("string")
    data = lambda **f: F.create_map(*[x for k, v in f.items() for x in (F.lit(k), text(v))])
    attribute = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("code"), text(v).alias("value"))
    variant = lambda *a, **f: F.struct(data(**f).alias("data"), F.array(*a).cast(J.F_ATTRIBUTES).alias("attributes"))
    p, s = C.items(spark, d), C.table(spark, d, "supplier")
    have = p.select(
        "doc_id", data(title=F.col("title"), brand=F.col("brand"), both=F.concat("title", "brand"), width="9").alias("data"),
        F.array(attribute("color", "red"), attribute("width", F.col("size"))).alias("attributes"), F.array(F.array(F.col("type"))).alias("categories"),
        F.array(variant(attribute("size", "1"), id="a", price=F.col("size")), variant(id="b", price="2"), variant(price="no id")).alias("variants"),
    )
    key = F.col("s_suppkey") * 3
    none = F.lit(None)
    new = s.select(
        key.alias("doc_id"), data(title=F.col("s_name")).alias("data"),
        F.when(key % 2 == 0, F.array(attribute("width", F.col("s_suppkey")), attribute("extra", "x"))).otherwise(none).alias("attributes"),
        F.when(key % 5 == 0, F.array(F.array(F.lit("new")))).otherwise(none).alias("categories"),
        F.when(key % 4 != 1, F.array(variant(attribute("size", "9"), id="a", stock="5"), variant(id="c", price="7"))).otherwise(none).alias("variants"),
    )
    return have, new


_PATCHED = """
SELECT p_partkey AS doc_id, coalesce(s_name, p_name) AS title,
  CASE WHEN k IS NULL THEN p_name || p_brand END AS both_, CASE WHEN k % 2 = 0 THEN NULL ELSE '9' END AS width,
  CASE WHEN k % 2 = 0 THEN 'color=red,width=' || CAST(s_suppkey AS VARCHAR) || ',extra=x' ELSE 'color=red,width=' || CAST(p_size AS VARCHAR) END AS attributes,
  CASE WHEN k % 5 = 0 THEN 'new' ELSE p_type END AS category,
  CASE WHEN k IS NULL OR k % 4 = 1 THEN 'a:' || CAST(p_size AS VARCHAR) || ':-:1,b:2:-:,-:no id:-:' ELSE 'a:' || CAST(p_size AS VARCHAR) || ':5:9,b:2:-:,c:7:-:' END AS variants
FROM part LEFT JOIN (SELECT *, s_suppkey * 3 AS k FROM supplier) ON k = p_partkey"""


def _shown(df):
    field = lambda v, k: F.coalesce(v["data"][k], F.lit("-"))
    shown = F.transform("variants", lambda v: F.concat_ws(":", field(v, "id"), field(v, "price"), field(v, "stock"), F.array_join(F.transform(v["attributes"], lambda a: a["value"]), "")))
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["name"], a["value"])), ",")
    return df.select(
        "doc_id", F.col("data.title").alias("title"), F.col("data.both").alias("both_"), F.col("data.width").alias("width"), attributes.alias("attributes"),
        F.col("categories")[0][0].alias("category"), F.array_join(shown, ",").alias("variants"),
    )


@query("mrg_patch", _PATCHED)
def mrg_patch(spark, d):
    have, new = _whole(spark, d)
    return _shown(J.patch_documents(have, new, {"both": ["title", "brand"]}, "id"))


@query("mrg_required_fields", f"WITH {C.SQL} SELECT doc_id, CASE name WHEN 'size' THEN 'number_facets' WHEN 'category' THEN 'path_facets' ELSE 'term_facets' END AS part, count(DISTINCT value) AS n FROM fv WHERE variant_pos IS NULL AND name IN ('brand', 'size', 'category') GROUP BY ALL")
def mrg_required_fields(spark, d):
    """What a patch of these fields has to read of each indexed document: the parts they are in, nothing else."""
    from .q_filters import FIELDS

    names = ("brand", "size", "category", "title", "image", "unknown")
    part_of = {n: p for n in names for p in J.required_fields([n], FIELDS)}
    part = F.coalesce(*[F.when(F.col("name") == n, F.lit(p)) for n, p in part_of.items()])
    needed = C.facet_values(C.items(spark, d)).filter(F.col("name").isin(*part_of))
    return needed.groupBy("doc_id", part.alias("part")).agg(F.countDistinct("value").alias("n"))


def _two_tables(spark, d, name):
    store = K.Store(spark, scratch.folder(spark, name))
    for table_name, locale in (("parts", "en"), ("suppliers", "de")):
        s = store.start(table_name, locale)
        store.add(s, C.table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), "n_name"))
        store.deploy(s)
    return store


@query("src_list_tenants", "SELECT * FROM (VALUES ('books-en'), ('parts-en'), ('suppliers-de'), ('toys-fr')) t(tenant)")
def src_list_tenants(spark, d):
    found = _two_tables(spark, d, "tenants").tenants(configured=("parts-en", "books-en"), loaded=("toys-fr",))
    return spark.createDataFrame([(t,) for t in found], "tenant string")


@query("snk_start_session", "SELECT * FROM (VALUES ('parts-en', 2), ('parts-en', 3)) t(name, version)")
def snk_start_session(spark, d):
    store = _two_tables(spark, d, "sessions")
    return spark.createDataFrame([store.start("parts", "EN"), store.start("parts", "en")], "name string, version int")


@query("snk_cancel", "SELECT 1 AS versions, count(*) AS n FROM nation")
def snk_cancel(spark, d):
    store = _two_tables(spark, d, "cancel")
    store.cancel(store.start("parts", "en"))
    return store.read("parts-en").agg(F.lit(len(store.versions("parts-en"))).alias("versions"), F.count(F.lit(1)).alias("n"))


@query("snk_cleanup", "SELECT 'parts-en/v=2' AS gone")
def snk_cleanup(spark, d):
    store = _two_tables(spark, d, "cleanup")
    store.start("parts", "en")
    return spark.createDataFrame([(g,) for g in store.cleanup(0)], "gone string")


@query("snk_suggest_archive", "SELECT p_name AS text, count(*) AS weight FROM part GROUP BY p_name")
def snk_suggest_archive(spark, d):
    """A reader polls for snapshots: it has the first, and after a second is published that one."""
    from ..operators import suggest_index as Q

    store = K.Store(spark, scratch.folder(spark, "suggest"))
    records = C.items(spark, d).groupBy(F.col("title").alias("text")).agg(F.count(F.lit(1)).alias("weight"), F.min("type").alias("secondary"))
    Q.publish(store, "titles", "en", records.withColumn("text", F.upper("text")))
    reader = Q.Poller(store, "titles-en")
    reader.current()
    Q.publish(store, "titles", "en", records)
    return reader.current().filter("stage = 1").select("text", "weight").distinct()

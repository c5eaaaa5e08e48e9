"""Queries of the scalar functions and of text analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..sources.catalog import table
from .registry import query

FOLD_SQL = f"translate(%s, '{S.FOLD_FROM}', '{S.FOLD_TO}')"


@query("fn_lower", "SELECT p_partkey, lower(p_name) AS v FROM part")
def fn_lower(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("v"))


@query("fn_asciify", f"SELECT doc_id, md5({FOLD_SQL % 'text'}) AS v FROM documents")
def fn_asciify(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.asciify(F.col("text"))).alias("v"))


@query("fn_replace", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS v FROM part")
def fn_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "[aeiou]+", "_").alias("v"))


@query("fn_index_name", "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || '#' || c_mktsegment || ' '), '[^a-z0-9_.]+', '-', 'g'), '^-+|-+$', '', 'g') AS v FROM customer")
def fn_index_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.index_name(F.concat("c_name", F.lit("#"), "c_mktsegment", F.lit(" "))).alias("v"))


@query("fn_url_encode", "SELECT page_id, replace(url_encode(url), '%20', '+') AS v, url AS back FROM pages")
def fn_url_encode(spark, d):
    e = F.url_encode("url")
    return table(spark, d, "pages").select("page_id", e.alias("v"), F.url_decode(e).alias("back"))


@query("fn_delimiter", "SELECT doc_id, md5(replace(text, ',', '%2C')) AS v, md5(replace(replace(text, ',', '%2C'), '%2C', ',')) AS back FROM documents")
def fn_delimiter(spark, d):
    e = S.escape_delimiter(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(e).alias("v"), F.md5(S.unescape_delimiter(e)).alias("back"))


@query("fn_escape_path", "SELECT page_id, replace(url, '/', '%2F') AS v FROM pages")
def fn_escape_path(spark, d):
    return table(spark, d, "pages").select("page_id", S.escape_path(F.col("url")).alias("v"))


RAW_SQL = "CASE l_linenumber % 4 WHEN 0 THEN CAST(l_orderkey AS VARCHAR) WHEN 1 THEN '-' || l_partkey || '.5' WHEN 2 THEN l_partkey || 'e3' ELSE ' ' || l_suppkey || 'x' END"


def _raw():
    n = F.col("l_linenumber") % 4
    return F.when(n == 0, F.col("l_orderkey").cast("string")).when(n == 1, F.concat(F.lit("-"), "l_partkey", F.lit(".5"))).when(n == 2, F.concat("l_partkey", F.lit("e3"))).otherwise(F.concat(F.lit(" "), "l_suppkey", F.lit("x")))


@query("fn_parse_number", rf"SELECT v, n, count(*) AS k FROM (SELECT {RAW_SQL} AS v, CASE WHEN regexp_matches(trim({RAW_SQL}), '^(-?\d+(\.\d+)?(E-\d+)?|-?\.\d+)$') THEN TRY_CAST(trim({RAW_SQL}) AS DOUBLE) END AS n FROM lineitem) GROUP BY v, n")
def fn_parse_number(spark, d):
    raw = table(spark, d, "lineitem").select(_raw().alias("v"))
    return raw.select("v", S.parse_number(F.col("v")).alias("n")).groupBy("v", "n").agg(F.count(F.lit(1)).alias("k"))


@query("fn_number_list", "SELECT p_partkey, CAST(len(l) AS INTEGER) AS n, coalesce(list_sum(l), 0.0) AS total FROM (SELECT p_partkey, [CAST(p_size AS DOUBLE), CAST(p_partkey AS DOUBLE)] AS l FROM part)")
def fn_number_list(spark, d):
    raw = F.array(F.col("p_size").cast("string"), F.col("p_name"), F.col("p_partkey").cast("string"), F.lit("x"))
    numbers = S.number_list(raw)
    return table(spark, d, "part").select("p_partkey", F.size(numbers).alias("n"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("fn_string_list", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '|' || CAST(p_size AS VARCHAR) AS v FROM part")
def fn_string_list(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.string_list(F.array(F.col("p_partkey").cast("long"), F.col("p_size").cast("long"))), "|").alias("v"))


@query("fn_first_int", r"SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '(\d+)', 1) AS INTEGER) AS v FROM orders")
def fn_first_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.first_int(F.col("o_orderpriority")).alias("v"))


@query("fn_round_money", "SELECT n, ceil(n / 8.0 * 100 - 0.5) / 100 + 0.0 AS down, floor(n / 8.0 * 100 + 0.5) / 100 AS up FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def fn_round_money(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select("n", S.half_down(F.col("n") / 8.0).alias("down"), S.half_up(F.col("n") / 8.0).alias("up"))


@query("fn_format_number", r"SELECT n, regexp_replace(printf('%.2f', n / 8.0 + 0.001), '\.?0+$', '') AS v FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def fn_format_number(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select("n", S.format_number(F.col("n") / 8.0 + 0.001, 2).alias("v"))


@query("fn_round_mode", "SELECT n, CAST(floor(n / 3.0) AS BIGINT) AS lo, CAST(ceil(n / 3.0) AS BIGINT) AS hi, CAST(round(n / 3.0) AS BIGINT) AS mid FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def fn_round_mode(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select("n", *[S.round_mode(F.col("n") / 3.0, m).cast("long").alias(a) for m, a in (("floor", "lo"), ("ceil", "hi"), ("round", "mid"))])


@query("fn_collect", "SELECT p_partkey, array_to_string(CASE WHEN p_brand = p_type THEN [p_brand, 'x'] ELSE [p_brand, p_type, 'x'] END, '|') AS v FROM part")
def fn_collect(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.collect_values(F.array("p_brand", "p_type"), F.array("p_brand", F.lit("x"))), "|").alias("v"))


@query("fn_minmax", "SELECT l_partkey AS p, CAST(CASE WHEN min(l_quantity) = max(l_quantity) THEN 1 ELSE 2 END AS INTEGER) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_partkey")
def fn_minmax(spark, d):
    # A bounded list would do for one product; sets are built from the two ends only.
    ends = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.array(F.min("l_quantity"), F.max("l_quantity")).alias("e"))
    return ends.select("p", F.size(S.min_max(F.col("e"))).alias("n"), F.array_min("e").alias("lo"), F.array_max("e").alias("hi"))


@query("fn_is_empty", "SELECT lang, CAST(sum(CASE WHEN text IS NULL OR length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM documents GROUP BY lang")
def fn_is_empty(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(S.is_empty(F.col("text")).cast("long")).alias("n"))


@query("fn_same_type", "SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS v FROM orders")
def fn_same_type(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.same_type(F.substring("o_orderpriority", 1, 1), "int").alias("v"))


@query("fn_as_float", "SELECT p_partkey, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS v FROM part")
def fn_as_float(spark, d):
    return table(spark, d, "part").select("p_partkey", S.as_float(F.col("p_size")).cast("double").alias("v"))


@query("fn_map_pairs", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def fn_map_pairs(spark, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", m["brand"].alias("brand"), m["size"].alias("size"))


@query("fn_map_overlay", "SELECT p_partkey, p_type AS a, p_brand AS b, p_name AS c FROM part")
def fn_map_overlay(spark, d):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("p_brand"))
    over = F.create_map(F.lit("a"), F.col("p_type"), F.lit("c"), F.col("p_name"))
    m = S.map_overlay(base, over)
    return table(spark, d, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("fn_json_value", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS none FROM events")
def fn_json_value(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_value(p, "$.k", "long").alias("k"), S.json_value(p, "$.missing", "string").alias("none"))


@query("fn_age", "SELECT o_orderkey, CAST(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) AS BIGINT) AS age FROM orders")
def fn_age(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.age_seconds(F.col("o_orderdate"), F.lit("2000-01-01 00:00:00").cast("timestamp")).alias("age"))


# --- text analysis -----------------------------------------------------------

_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_STRIP = "regexp_replace(regexp_replace({0}, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>|&[a-z]+;|&#[0-9]+;', ' ', 'g')"
_MINIMAL = _WORDS.format("regexp_replace(lower(" + _STRIP + "), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')")


@query("txt_minimal", f"SELECT page_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS v FROM (SELECT page_id, {_MINIMAL.format('html')} AS t FROM pages)")
def txt_minimal(spark, d):
    t = X.minimal(F.col("html"))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("v"))


@query("txt_standard")
def txt_standard(spark, d):
    docs = table(spark, d, "documents")
    # There are analyzers for two languages; texts of others are lower-case words.
    tokens = F.when(F.col("lang") == "de", X.standard(F.col("text"), "de")).when(F.col("lang") == "en", X.standard(F.col("text"), "en")).otherwise(X.words(F.lower("text")))
    return docs.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("v"))


@query("txt_char_map", "SELECT doc_id, md5(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS v FROM documents")
def txt_char_map(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.german_characters(F.col("text"))).alias("v"))


_T = _WORDS.format("lower(p_name)")


@query("txt_shingle", f"SELECT p_partkey, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1]), ' ') AS v FROM (SELECT p_partkey, {_T} AS t FROM part)")
def txt_shingle(spark, d):
    return table(spark, d, "part").select("p_partkey", X.words(F.lower("p_name")).alias("t")).select("p_partkey", F.array_join(X.shingle(F.col("t")), " ").alias("v"))


@query("txt_ngram", "SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3))) AS g FROM part) GROUP BY g")
def txt_ngram(spark, d):
    grams = table(spark, d, "part").select(F.explode(X.ngrams(F.col("p_name"))).alias("g"))
    return grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("txt_ws_terms", f"SELECT item_id, array_to_string({_WORDS.format('trim(lower(text))')}, '|') AS v FROM benchmark")
def txt_ws_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), "|").alias("v"))


@query("txt_ws_shingles", f"SELECT item_id, array_to_string(flatten(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i < len(t) THEN [t[i], t[i] || t[i + 1]] ELSE [t[i]] END)), '|') AS v FROM (SELECT item_id, {_WORDS.format('trim(lower(text))')} AS t FROM benchmark)")
def txt_ws_shingles(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.query_shingles(F.col("text")), "|").alias("v"))


@query("txt_strip_nonalnum", r"SELECT doc_id, md5(trim(regexp_replace(text, '[^\p{L}\p{N}\-\_\.\&\+\''\/]+', ' ', 'g'))) AS v FROM documents")
def txt_strip_nonalnum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_nonalnum(F.col("text"))).alias("v"))


@query("txt_query_asciify", f"SELECT item_id, {FOLD_SQL % 'text'} AS v FROM benchmark")
def txt_query_asciify(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.query_asciify(F.col("text")).alias("v"))


@query("txt_escape", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || ' -<b> x-y (z)', '[<>]', '', 'g'), '([+=&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g'), '(^|\s)-', '\1\\-', 'g') AS v FROM pages""")
def txt_escape(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape(F.concat("url", F.lit(" -<b> x-y (z)"))).alias("v"))


@query("txt_dedupe_adjacent", f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n, md5(array_to_string(k, ' ')) AS v FROM (SELECT doc_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: x[2] = 1 OR x[1] <> t[x[2] - 1]), lambda x: x[1]) AS k FROM (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents))")
def txt_dedupe_adjacent(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("t")).select("doc_id", X.dedupe_adjacent(F.col("t")).alias("k"))
    return t.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("v"))

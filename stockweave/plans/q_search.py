"""Queries of matching, rules, scoring, sorting, relaxation, arrangement and suggest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fuzzy as Z
from ..operators import matching as M
from ..operators import postings as N
from ..operators import ranking as K
from ..operators import suggest as G
from ..sources import catalog as C
from ..sources import scratch
from . import graph, params, prodsets, querystring, rules, search
from .params import Filter, SearchRequest, Sort
from .q_filters import FIELDS
from .registry import query

_W = f"WITH {C.SQL} "
_T = "string_split(title, ' ')"


def titled(spark, d):
    return C.items(spark, d).withColumn("tokens", F.split("title", " "))


T = F.col


def tok():
    return F.col("tokens")


# --- matching ----------------------------------------------------------------


@query("mat_configurable", _W + f"SELECT doc_id, CAST(list_contains({_T}, 'red') AS INTEGER) + CAST(list_contains({_T}, 'bolt') AS INTEGER) + CAST(list_contains({_T}, 'old') AS INTEGER) AS matched FROM items WHERE matched >= 2")
def mat_configurable(spark, d):
    return M.match(titled(spark, d), tok(), ["red", "bolt", "old"], "2").select("doc_id", "matched")


_SPECS = ("2<80%", "-1", "-25%", "50%", "1")


@query("mat_min_should_match", _W + f"SELECT spec, doc_id, matched FROM (SELECT doc_id, CAST(list_sum([CAST(list_contains(w, x) AS INTEGER) FOR x IN ['red', 'bolt', 'red', 'old']]) AS BIGINT) AS matched FROM (SELECT doc_id, {_T} AS w FROM items)), (VALUES ('2<80%', 3), ('-1', 3), ('-25%', 3), ('50%', 2), ('1', 1)) t(spec, k) WHERE matched >= k")
def mat_min_should_match(spark, d):
    """Each way to say how many of four terms (one of them twice) must match, on all products."""
    x = titled(spark, d)
    return reduce(DataFrame.unionByName, [M.match(x, tok(), ["red", "bolt", "red", "old"], s).select(F.lit(s).alias("spec"), "doc_id", F.col("matched").cast("long").alias("matched")) for s in _SPECS])


@query("mat_phrase_boost", _W + f"SELECT doc_id, round(CAST(list_contains({_T}, 'red') AS INTEGER) + CAST(list_contains({_T}, 'bolt') AS INTEGER) + 1.1 * (CAST(list_contains({_T}, 'red') AS INTEGER) + CAST(list_contains({_T}, 'bolt') AS INTEGER)) + CASE WHEN title = 'red bolt' THEN 1.5 ELSE 0.0 END, 6) AS score FROM items")
def mat_phrase_boost(spark, d):
    return titled(spark, d).select("doc_id", F.round(M.phrase_boosted(tok(), F.split("title", " "), ["red", "bolt"]), 6).alias("score"))


_GLUED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_append({t}, replace(title, ' ', '')) ELSE {t} END AS t FROM items"


@query("mat_shingle_variants", _W + f", g AS ({_GLUED.format(t=_T)}), h AS (SELECT doc_id, CAST(list_contains(t, 'small') AS INTEGER) AS a, CAST(list_contains(t, 'red') AS INTEGER) AS b, CAST(list_contains(t, 'bolt') AS INTEGER) AS c, CAST(list_contains(t, 'smallred') AS INTEGER) AS ab, CAST(list_contains(t, 'redbolt') AS INTEGER) AS bc FROM g) SELECT doc_id, round(greatest(a + b + c, 0.9 * (2 * ab + c), 0.9 * (2 * bc + a)), 6) AS score FROM h")
def mat_shingle_variants(spark, d):
    glued = F.when(F.col("doc_id") % 3 == 0, F.array_append(tok(), F.replace("title", F.lit(" "), F.lit("")))).otherwise(tok())
    return titled(spark, d).select("doc_id", F.round(M.shingle_variants(glued, ["small", "red", "bolt"]), 6).alias("score"))


_CROSS = "greatest(CASE WHEN list_contains({t}, '{w}') THEN 2.0 ELSE 0.0 END, CASE WHEN lower(brand) = '{w}' THEN 1.0 ELSE 0.0 END)"


@query("mat_match_type", _W + f"SELECT doc_id, {_CROSS.format(t=_T, w='red')} + {_CROSS.format(t=_T, w='brand#11')} AS crossed FROM items")
def mat_match_type(spark, d):
    fields = {"title": tok(), "brand": F.array(F.lower("brand"))}
    return titled(spark, d).select("doc_id", M.cross_fields(fields, ["red", "brand#11"], {"title": 2.0, "brand": 1.0}).alias("crossed"))


_NEAR = "CAST(len(list_filter({0}, lambda w: levenshtein(w, '{1}') <= {2})) > 0 AS INTEGER)"
_DEFAULT = [(t, k, _NEAR.format(_T, t, k), _NEAR.format("[lower(brand)]", t, k)) for t, k in (("red", 1), ("bolr", 1), ("brand#11", 2))]


@query("mat_default", _W + ", m AS (SELECT doc_id, " + ", ".join(f"2.0 * {a} AS a{i}, 1.0 * {b} AS b{i}" for i, (_, _, a, b) in enumerate(_DEFAULT)) + " FROM items) SELECT doc_id, round(" + " + ".join(f"greatest(a{i}, b{i}) + 0.8 * least(a{i}, b{i})" for i in range(3)) + ", 6) AS score FROM m WHERE " + " + ".join(f"CAST(a{i} + b{i} > 0 AS INTEGER)" for i in range(3)) + " >= 2")
def mat_default(spark, d):
    hit, score = M.fuzzy_default({"title": tok(), "brand": F.array(F.lower("brand"))}, ["red", "bolr", "brand#11"], {"title": 2.0, "brand": 1.0})
    return titled(spark, d).filter(hit).select("doc_id", F.round(score, 6).alias("score"))


@query("mat_dismax", _W + f"SELECT doc_id, round(greatest(a, b) + 0.2 * (a + b - greatest(a, b)), 6) AS score FROM (SELECT doc_id, CAST(list_contains({_T}, 'red') AS DOUBLE) AS a, CASE WHEN split_part(title, ' ', 2) LIKE 'bo%' OR split_part(title, ' ', 1) LIKE 'bo%' THEN 1.5 ELSE 0.0 END AS b FROM items)")
def mat_dismax(spark, d):
    a, b = M.has(tok(), "red").cast("double"), F.when(M.phrase_prefix(tok(), ["bo"]), 1.5).otherwise(0.0)
    return titled(spark, d).select("doc_id", F.round(M.dis_max([a, b], 0.2), 6).alias("score"))


@query("mat_ngram", _W + "SELECT doc_id, (CAST(contains(title, 'wid') AS INTEGER) + CAST(contains(title, 'idg') AS INTEGER) + CAST(contains(title, 'dge') AS INTEGER) + CAST(contains(title, 'ger') AS INTEGER)) / 4.0 AS share FROM items WHERE share >= 0.7")
def mat_ngram(spark, d):
    return C.items(spark, d).select("doc_id", M.trigram_share(F.col("title"), "widger").alias("share")).filter("share >= 0.7")


@query("mat_fuzzy", _W + f"SELECT doc_id, title FROM items WHERE len(list_filter({_T}, lambda w: levenshtein(w, 'bolr') <= 1)) > 0")
def mat_fuzzy(spark, d):
    """The dictionary gives the words near to the term; documents are matched by these as they are."""
    x = titled(spark, d)
    words = Z.expansions(Z.build(Z.words_of(x, tok()), 1), ["bolr"], 1)["bolr"]
    return x.filter(F.arrays_overlap(tok(), F.array(*map(F.lit, words)).cast("array<string>"))).select("doc_id", "title")


@query("mat_fuzzy_batch", "WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS word FROM documents) GROUP BY word), t AS (SELECT DISTINCT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS term FROM benchmark) SELECT term, word, CAST(levenshtein(term, word) AS INTEGER) AS distance, n FROM t JOIN w ON abs(length(term) - length(word)) <= 2 AND levenshtein(term, word) <= CASE WHEN length(term) < 3 THEN 0 WHEN length(term) < 6 THEN 1 ELSE 2 END")
def mat_fuzzy_batch(spark, d):
    """For every word of the benchmark texts, the words of all documents within its AUTO edits."""
    words = Z.build(Z.words_of(C.table(spark, d, "documents"), _letters()))
    asked = C.table(spark, d, "benchmark").select(F.explode(_letters()).alias("term")).withColumn("edits", Z.auto_edits(F.col("term")))
    return Z.near(words, asked)


_MASK = f"SELECT CAST(list_contains({_T}, 'red') AS INTEGER) + 2 * CAST(list_contains({_T}, 'bolt') AS INTEGER) + 4 * CAST(list_contains({_T}, 'old') AS INTEGER) AS mask FROM items"


@query("mat_cooccurrence", _W + f"SELECT mask, count(*) AS n FROM ({_MASK}) WHERE mask > 0 GROUP BY mask")
def mat_cooccurrence(spark, d):
    return M.cooccurrence(titled(spark, d), tok(), ["red", "bolr", "old"], {"bolr": "bolt"})


@query("mat_relaxed", _W + f"SELECT doc_id, matched FROM (SELECT doc_id, CAST(list_contains({_T}, 'red') AS INTEGER) + CAST(list_contains({_T}, 'bolt') AS INTEGER) + CAST(list_contains({_T}, 'old') AS INTEGER) AS matched FROM items) WHERE matched = 2")
def mat_relaxed(spark, d):
    return M.relaxed(titled(spark, d), tok(), ["red", "bolt", "old"]).select("doc_id", "matched")


@query("mat_prediction", _W + f", i AS (SELECT doc_id, mask FROM items JOIN (SELECT doc_id AS k, {_MASK[7:-11]} FROM items) ON k = doc_id), m AS (SELECT mask, count(*) AS n FROM i WHERE mask > 0 GROUP BY mask), p AS (SELECT a.mask, sum(b.n) AS matches FROM m a JOIN m b ON (b.mask & a.mask) = a.mask GROUP BY a.mask), o AS (SELECT mask, coalesce(sum(matches) OVER (ORDER BY mask = 7 DESC, bit_count(mask) DESC, matches, mask ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT doc_id, CAST(bit_count(mask) AS DOUBLE) AS score FROM i WHERE EXISTS (SELECT 1 FROM o WHERE before < 12 AND (i.mask & o.mask) = o.mask)")
def mat_prediction(spark, d):
    return M.predicted(titled(spark, d), tok(), ["red", "bolt", "old"]).select("doc_id", "score")


@query("mat_prediction_order", _W + f", m AS (SELECT mask, count(*) AS n FROM ({_MASK}) WHERE mask > 0 GROUP BY mask), p AS (SELECT a.mask, CAST(sum(b.n) AS BIGINT) AS matches FROM m a JOIN m b ON (b.mask & a.mask) = a.mask GROUP BY a.mask) SELECT row_number() OVER (ORDER BY mask = 7 DESC, bit_count(mask) DESC, matches, mask) - 1 AS pos, concat_ws(' ', CASE WHEN mask & 1 > 0 THEN 'red' END, CASE WHEN mask & 2 > 0 THEN 'bolt' END, CASE WHEN mask & 4 > 0 THEN 'old' END) AS terms, matches FROM p")
def mat_prediction_order(spark, d):
    """The order of the predicted queries, by what the catalog has of each."""
    terms = ["red", "bolt", "old"]
    counts = [(r["mask"], r["n"]) for r in M.cooccurrence(titled(spark, d), tok(), terms).collect()]  # at most 2 ** terms rows
    got = M.predicted_queries(counts, terms)
    return spark.createDataFrame([(i, " ".join(p["terms"]), p["matches"]) for i, p in enumerate(got)], "pos long, terms string, matches long")


@query("mat_variant_any", _W + "SELECT doc_id, round(max(greatest(a, b) + 0.2 * least(a, b)), 6) AS score FROM (SELECT doc_id, CASE WHEN color = 'R' THEN 2.0 ELSE 0.0 END AS a, CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END AS b FROM variants) WHERE a + b > 0 GROUP BY doc_id")
def mat_variant_any(spark, d):
    hit, score = M.match_any({"color": F.array(F.lower("color")), "status": F.array(F.lower("status"))}, ["r", "o"], {"color": 2.0, "status": 1.0})
    return C.variants(spark, d, False).filter(hit).groupBy("doc_id").agg(F.round(F.max(score), 6).alias("score"))


@query("mat_none", _W + "SELECT doc_id, title FROM items WHERE false")
def mat_none(spark, d):
    return search.run_stage(titled(spark, d), tok(), ["x"], search.Stage("none", "none")).select("doc_id", "title")


def _fields():
    return {"title": tok(), "brand": F.array(F.lower("brand")), "type": F.split(F.lower("type"), " ")}


@query("mat_querystring", _W + f"SELECT doc_id, CASE WHEN list_contains({_T}, 'red') THEN 2.0 ELSE 0.0 END + CASE WHEN lower(brand) = 'brand#11' THEN 4.0 ELSE 0.0 END + CASE WHEN len(list_filter({_T}, lambda w: w LIKE 'wid%')) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN title = 'old gear' THEN 2.0 ELSE 0.0 END AS score FROM items WHERE NOT list_contains({_T}, 'bolt') AND score > 0")
def mat_querystring(spark, d):
    found = querystring.search(titled(spark, d), 'red -title:bolt brand:"Brand#11"^4 title:wid* "old gear"', _fields(), {"title": 2.0})
    return found.select("doc_id", "score")


@query("mat_exclude_ids", _W + "SELECT doc_id FROM items WHERE doc_id NOT IN (SELECT s_suppkey FROM supplier)")
def mat_exclude_ids(spark, d):
    gone = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    return C.items(spark, d).select("doc_id").join(gone, "doc_id", "left_anti")


@query("mat_must_not_terms", _W + f"SELECT doc_id FROM items WHERE NOT list_contains({_T}, 'red')")
def mat_must_not_terms(spark, d):
    return titled(spark, d).filter(~M.has(tok(), "red")).select("doc_id")


@query("mat_spellcheck", _W + ", w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(title, ' ')) AS word FROM items) GROUP BY word), p AS (SELECT t.term, word, n, 1 - levenshtein(word, t.term) / greatest(length(word), length(t.term)) AS score FROM w, (VALUES ('widgat'), ('anvill')) t(term) WHERE abs(length(word) - length(t.term)) <= 2) SELECT term, word AS correction, round(score, 6) AS score FROM p WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, n DESC, word) = 1")
def mat_spellcheck(spark, d):
    words = titled(spark, d).select(F.explode(tok()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return M.spell_corrections(words, ["widgat", "anvill"])


@query("mat_fields_validate", _W + f"SELECT doc_id, CASE WHEN list_contains({_T}, 'red') THEN 2.0 ELSE 0.0 END AS score FROM items WHERE list_contains({_T}, 'red')")
def mat_fields_validate(spark, d):
    """A search over fields of which one may be searched, one may not and one is unknown."""
    wanted = {"title": 2.0, "brand": 1.0, "unknown": 3.0}
    kept = {n: w for n, w in wanted.items() if any("SEARCH" in f.usage for f in FIELDS.match(n))}
    fields = {n: c for n, c in _fields().items() if n in kept}
    hit, score = M.match_any(fields, ["red", "brand#11"], kept, 0.0)
    return titled(spark, d).filter(hit).select("doc_id", score.alias("score"))


_TOKENS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_BM = "ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))"


@query("mat_relevance", f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), f AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS tf0, len(list_filter(w, lambda x: x = 'von')) AS tf1 FROM t), s AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f) SELECT doc_id, round({_BM.format(i=0)} + {_BM.format(i=1)}, 4) AS score FROM f, s")
def mat_relevance(spark, d):
    x = C.table(spark, d, "documents").select("doc_id", X.words(F.lower("text")).alias("tokens"))
    counted = M.term_counts(x, tok(), ["the", "von"]).drop("tokens")
    kept = scratch.keep(counted, "counts")  # texts are tokenised once; a document's counts are a few bytes
    return M.bm25_counted(kept, 2).select("doc_id", F.round("score", 4).alias("score"))


_ASCII = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')"


def _letters(text="text"):
    """Runs of a-z; capitals of ASCII count as small letters."""
    runs = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]+", " ")))
    return F.when(runs == "", F.array().cast("array<string>")).otherwise(F.split(runs, " "))


@query("mat_relevance_batch", f"""WITH d AS (SELECT doc_id, {_ASCII} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term, len(w) AS len FROM d), f AS (SELECT term, doc_id, len, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM d), t AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT item_id, unnest({_ASCII}) AS term FROM benchmark), a AS (SELECT item_id, term, count(*) AS weight FROM q GROUP BY ALL),
m AS (SELECT item_id, doc_id, CAST(sum(CAST(round(a.weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) * 1000000) AS BIGINT)) AS BIGINT) AS score FROM a JOIN f USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, doc_id, round(score / 1000000.0, 3) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 10""")
def mat_relevance_batch(spark, d):
    """The ten best documents of each benchmark text, from a stored index: no text is read again for a query."""
    index = N.build(C.table(spark, d, "documents"), _letters())
    asked = N.terms_of(C.table(spark, d, "benchmark"), _letters(), "item_id")
    best = N.top(N.score(index, asked), 10)
    return best.select(F.col("query").alias("item_id"), "doc_id", F.round(F.col("score") / N.MICRO, 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("mat_phrase_batch", f"WITH d AS (SELECT doc_id, ' ' || array_to_string({_ASCII}, ' ') || ' ' AS t FROM documents), q AS (SELECT item_id, ' ' || array_to_string(({_ASCII})[1:4], ' ') || ' ' AS p FROM benchmark WHERE len({_ASCII}) >= 4) SELECT item_id, doc_id FROM q JOIN d ON contains(t, p)")
def mat_phrase_batch(spark, d):
    """The documents that hold the first four words of a benchmark text in a row, by positions."""
    index = N.build(C.table(spark, d, "documents"), _letters())
    words = C.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.slice(_letters(), 1, 4).alias("words")).filter(F.size("words") >= 4)
    return N.phrases(index, words).select(F.col("query").alias("item_id"), "doc_id")


# --- rules -------------------------------------------------------------------

RULES = """
red => SYNONYM: crimson ; SYNONYM(0.5): scarlet
cheap red => DELETE
bolt => FILTER: brand:Brand#11 ; UP(2): new ; DOWN(0.5): old
gear => FILTER: -brand:Brand#12 ; FILTER: odd
"""


def _rewrite(q):
    return rules.rewrite(q, rules.parse_rules(RULES))


#: Two rules of two terms overlap in ``bolt``.
GRAPH_RULES = """
red bolt => SYNONYM(1.6): gear ; SYNONYM(1.3): small widget
bolt ring => SYNONYM(0.7): (old anvil)
ring => SYNONYM(0.5): plate
old => SYNONYM: vintage ; DELETE
cold gizmo => DELETE
gizmo => SYNONYM(0.9): gadget thing
"""
_SPANS = f"""g AS (SELECT doc_id, CASE WHEN list_contains(w, 'red') THEN 1.0 ELSE 0.0 END AS a, CASE WHEN list_contains(w, 'bolt') THEN 1.0 ELSE 0.0 END AS b,
  CASE WHEN list_contains(w, 'ring') THEN 1.0 WHEN list_contains(w, 'plate') THEN 0.5 ELSE 0.0 END AS c,
  CASE WHEN list_contains(w, 'gear') THEN 1.6 WHEN title = 'small widget' THEN 1.3 ELSE 0.0 END AS ab, CASE WHEN title = 'old anvil' THEN 0.7 ELSE 0.0 END AS bc FROM (SELECT doc_id, title, {_T} AS w FROM items)),
v AS (SELECT doc_id, CASE WHEN CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) + CAST(c > 0 AS INTEGER) >= 2 THEN a + b + c END AS x,
  CASE WHEN CAST(ab > 0 AS INTEGER) + CAST(c > 0 AS INTEGER) >= 1 THEN ab + c END AS y, CASE WHEN CAST(a > 0 AS INTEGER) + CAST(bc > 0 AS INTEGER) >= 1 THEN a + bc END AS z FROM g)"""


@query("rul_synonym", _W + f", {_SPANS} SELECT doc_id, round(greatest(x, y, z), 6) AS score FROM v WHERE coalesce(x, y, z) IS NOT NULL")
def rul_synonym(spark, d):
    """Three variants of one query, made by overlapping rules of several terms."""
    found = graph.search(titled(spark, d), {"title": tok()}, graph.build("red bolt ring", rules.parse_rules(GRAPH_RULES)), spec="-1")
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _titles(spark, d):
    """The distinct titles as a log of queries."""
    return C.items(spark, d).select(F.col("title").alias("query")).distinct().withColumn("terms", F.split("query", " "))


@query("rul_delete", _W + "SELECT DISTINCT title AS query, CASE WHEN title IN ('cold gizmo') THEN title WHEN title LIKE 'old %' THEN substr(title, 5) ELSE title END AS rewritten FROM items")
def rul_delete(spark, d):
    """Rules that delete terms, on all queries; one that would lose all its terms keeps them."""
    done = graph.without_deleted(_titles(spark, d), rules.parse_rules(GRAPH_RULES))
    return done.select("query", F.array_join("terms", " ").alias("rewritten"))


@query("rul_filter", _W + f"SELECT doc_id FROM items WHERE list_contains({_T}, 'bolt') AND brand = 'Brand#11'")
def rul_filter(spark, d):
    from ..operators.filters import apply_filters

    got = _rewrite("bolt")
    x = titled(spark, d)
    return apply_filters(M.match(x, tok(), got.terms), C.facet_values(x), got.filters).select("doc_id")


@query("rul_filter_merge", _W + f"SELECT doc_id FROM items WHERE list_contains({_T}, 'rod') AND brand IN ('Brand#11', 'Brand#12')")
def rul_filter_merge(spark, d):
    """Three rules filter one field: values are united, an including filter beats an excluding one."""
    from ..operators.filters import apply_filters

    merging = rules.parse_rules("rod => FILTER: brand:Brand#11 ; FILTER: -brand:Brand#13 ; FILTER: brand:Brand#12")
    got = rules.rewrite("rod", merging)
    x = titled(spark, d)
    return apply_filters(M.match(x, tok(), got.terms), C.facet_values(x), got.filters).select("doc_id")


@query("rul_boost", _W + f"SELECT doc_id, (1.0 + CASE WHEN list_contains({_T}, 'new') THEN 2.0 ELSE 0.0 END) * CASE WHEN list_contains({_T}, 'old') THEN 0.5 ELSE 1.0 END AS score FROM items WHERE list_contains({_T}, 'bolt')")
def rul_boost(spark, d):
    x = M.match(titled(spark, d), tok(), ["bolt"])
    score = F.lit(1.0)
    for term, w in _rewrite("bolt").boosts:
        score = K.up_down(score, M.has(tok(), term), up=w) if w > 0 else K.up_down(score, M.has(tok(), term), down=-w)
    return x.select("doc_id", score.alias("score"))


_AST = """, q AS (SELECT DISTINCT title AS query, split_part(title, ' ', 1) AS x, split_part(title, ' ', 2) AS y FROM items),
r(head, text, weight) AS (VALUES ('red bolt', 'gear', 1.6), ('red bolt', 'small widget', 1.3), ('bolt ring', 'old anvil', 0.7), ('ring', 'plate', 0.5), ('old', 'vintage', 1.0), ('gizmo', 'gadget thing', 0.9)),
runs AS (SELECT query, 0 AS a, 1 AS b, x AS head FROM q UNION ALL SELECT query, 1, 2, y FROM q UNION ALL SELECT query, 0, 2, query FROM q)
SELECT query, a AS "begin", b AS "end", head AS text, CAST(1.0 AS DOUBLE) AS weight FROM runs WHERE b = a + 1 UNION ALL SELECT query, a, b, text, CAST(weight AS DOUBLE) FROM runs JOIN r USING (head)"""


@query("rul_term_ast", _W + _AST)
def rul_term_ast(spark, d):
    """The token graphs of all titles: terms and weighted alternatives of their runs."""
    return graph.edges(_titles(spark, d), rules.parse_rules(GRAPH_RULES)).select("query", "begin", "end", "text", "weight")


# --- scoring -----------------------------------------------------------------


@query("sco_weight", _W + "SELECT doc_id, 2.5 AS score FROM items")
def sco_weight(spark, d):
    return C.items(spark, d).select("doc_id", F.lit(2.5).alias("score"))


@query("sco_field_value", _W + "SELECT doc_id, round(log10(price * 1.2 + 1) * 2, 5) AS a, round(sqrt(size), 5) AS b, round(1.0 / size, 5) AS c FROM items")
def sco_field_value(spark, d):
    p, s = F.col("price"), F.col("size").cast("double")
    return C.items(spark, d).select("doc_id", F.round(K.field_value(p, 1.2, "log1p", weight=2), 5).alias("a"), F.round(K.field_value(s, modifier="sqrt"), 5).alias("b"), F.round(K.field_value(s, modifier="reciprocal"), 5).alias("c"))


def _decay(kind):
    def run(spark, d):
        size = C.items(spark, d).select(F.lit("size").alias("kind"), "doc_id", F.round(K.decay(F.col("size").cast("double"), kind, 25.0, 10.0, 2.0), 5).alias("score"))
        date = C.table(spark, d, "orders").select(F.lit("date"), "o_orderkey", F.round(K.decay(F.col("o_orderdate"), kind, "1995-06-17 00:00:00", 30.0), 5))
        return size.union(date)

    return run


def _decay_sql(formula: str) -> str:
    far = "greatest(abs(size - 25.0) - 2.0, 0.0)", "abs((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17')) / 86400000000.0)"
    return _W + f"SELECT 'size' AS kind, doc_id, round({formula.format(far=far[0], scale=10.0)}, 5) AS score FROM items UNION ALL SELECT 'date', o_orderkey, round({formula.format(far=far[1], scale=30.0)}, 5) FROM orders"


query("sco_decay_gauss", _decay_sql("exp(power({far}, 2) * ln(0.5) / power({scale}, 2))"))(_decay("gauss"))
query("sco_decay_exp", _decay_sql("exp({far} * ln(0.5) / {scale})"))(_decay("exp"))
query("sco_decay_linear", _decay_sql("greatest(0.0, (2 * {scale} - {far}) / (2 * {scale}))"))(_decay("linear"))


@query("sco_random")
def sco_random(spark, d):
    return C.items(spark, d).select("doc_id", K.random_score(F.col("doc_id"), 7).alias("score"))


@query("sco_script", _W + "SELECT doc_id, price * 2 + size AS score FROM items")
def sco_script(spark, d):
    return C.items(spark, d).select("doc_id", F.expr("price * 2 + size").alias("score"))


@query("sco_rank_feature", _W + "SELECT doc_id, round(CASE WHEN size > 25 THEN size / (size + 10.0) ELSE 0.1 END, 5) AS score FROM items")
def sco_rank_feature(spark, d):
    features = F.when(F.col("size") > 25, F.create_map(F.lit("popularity"), F.col("size").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return C.items(spark, d).select("doc_id", F.round(K.rank_feature(features, "popularity", pivot=10.0, missing=0.1), 5).alias("score"))


@query("sco_combine", _W + "SELECT doc_id, round((1.0 + (size + price) / 2) / 2, 4) AS a, least(size, price) AS b, size * price AS c FROM items")
def sco_combine(spark, d):
    s, p = F.col("size").cast("double"), F.col("price")
    return C.items(spark, d).select("doc_id", F.round(K.boost(F.lit(1.0), K.combine([s, p])), 4).alias("a"), K.combine([s, p], "min").alias("b"), K.combine([s, p], "multiply").alias("c"))


@query("sco_variant_level", _W + "SELECT doc_id, variant_pos, round(sqrt(stock), 5) AS score FROM variants")
def sco_variant_level(spark, d):
    return C.variants(spark, d).select("doc_id", "variant_pos", F.round(K.field_value(F.col("stock"), modifier="sqrt"), 5).alias("score"))


@query("sco_boost_up_down", _W + f"SELECT doc_id, 10.0 * CASE WHEN list_contains({_T}, 'old') THEN 0.25 ELSE 1.0 END + CASE WHEN list_contains({_T}, 'new') THEN 3.0 ELSE 0.0 END AS score FROM items")
def sco_boost_up_down(spark, d):
    s = K.up_down(F.lit(10.0), M.has(tok(), "old"), down=4.0)
    return titled(spark, d).select("doc_id", K.up_down(s, M.has(tok(), "new"), up=3.0).alias("score"))


@query("sco_rescore", _W + ", r AS (SELECT doc_id, price, size, row_number() OVER (ORDER BY price DESC, doc_id) AS r FROM items WHERE brand = 'Brand#11') SELECT doc_id, CASE WHEN r <= 10 THEN CAST(size AS DOUBLE) ELSE price END AS score, CAST(r > 10 AS INTEGER) AS tier FROM r")
def sco_rescore(spark, d):
    hits = C.items(spark, d).filter("brand = 'Brand#11'").select("doc_id", "size", F.col("price").alias("score"))
    return K.rescore(hits, 10, lambda t: t.withColumn("score", F.col("size").cast("double"))).select("doc_id", "score", "tier")


def _sets(spark, d):
    s = C.table(spark, d, "supplier")
    one = s.select((F.col("s_suppkey") * 5).alias("doc_id"), F.col("s_suppkey").cast("long").alias("pos"))
    return [one, s.select((F.col("s_suppkey") * 7).alias("doc_id"), F.col("s_suppkey").cast("long").alias("pos"))]


_SETS = "l AS (SELECT s_suppkey * 5 AS k, 0 AS set_no, s_suppkey AS pos FROM supplier UNION ALL SELECT s_suppkey * 7, 1, s_suppkey FROM supplier), f AS (SELECT k, min((set_no, pos)) AS p FROM l GROUP BY k)"


@query("sco_hero_boost", _W + f", {_SETS} SELECT doc_id, greatest(price, coalesce(10.0 * CASE p[1] WHEN 0 THEN 1000.0 ELSE 1.0 END * greatest(1000 - p[2], 1), 0.0)) AS score FROM items LEFT JOIN f ON k = doc_id")
def sco_hero_boost(spark, d):
    return K.hero_boost(C.items(spark, d).select("doc_id", F.col("price").alias("score")), _sets(spark, d)).select("doc_id", "score")


# --- sorting, paging, variants -----------------------------------------------


@query("srt_parse", _W + "SELECT doc_id, CAST(row_number() OVER (ORDER BY price DESC, size, doc_id) AS INTEGER) AS pos FROM items")
def srt_parse(spark, d):
    """A sort parameter with a field that can't be sorted by, applied to all products."""
    sorts = params.parse_sort("image,-price,size,unknown", FIELDS)
    hits = C.items(spark, d).select("doc_id", *[F.col(s.field).cast("double").alias(f"{s.field}_{end}") for s in sorts for end in ("lo", "hi")])
    return K.positions(hits, K.sort_columns(sorts, with_score=False)).select("doc_id", F.col("pos").cast("int").alias("pos"))


_ENDS = "e AS (SELECT doc_id, min(price) AS price_lo, max(price) AS price_hi FROM variants GROUP BY doc_id)"


@query("srt_field", _W + f", {_ENDS} SELECT i.doc_id, CAST(row_number() OVER (ORDER BY coalesce(price_hi, 0) DESC, size DESC, i.doc_id) AS INTEGER) AS pos FROM items i LEFT JOIN e ON e.doc_id = i.doc_id")
def srt_field(spark, d):
    ends = C.variants(spark, d, False).groupBy("doc_id").agg(F.min("price").alias("price_lo"), F.max("price").alias("price_hi"))
    hits = C.items(spark, d).select("doc_id", F.col("size").alias("score")).join(ends, "doc_id", "left")
    return K.positions(hits, K.sort_columns([Sort("price", True)])).select("doc_id", F.col("pos").cast("int").alias("pos"))


@query("srt_facet_value", _W + "SELECT i.doc_id, max(v.price) AS sort_value FROM items i LEFT JOIN variants v ON v.doc_id = i.doc_id AND color = 'R' GROUP BY i.doc_id")
def srt_facet_value(spark, d):
    red = C.variants(spark, d, False).filter("color = 'R'").select("doc_id", F.lit("red_price").alias("name"), F.col("price").alias("num_value"))
    return K.facet_value_sort(C.items(spark, d).select("doc_id"), red, "red_price", True)


@query("srt_variant", _W + "SELECT doc_id, variant_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY price, variant_pos) AS INTEGER) AS rank FROM variants")
def srt_variant(spark, d):
    from pyspark.sql import Window

    return C.variants(spark, d).select("doc_id", "variant_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("price", "variant_pos")).alias("rank"))


_OPTIONS = [("price", True), ("price", False), ("size", True), ("size", False)]


@query("srt_options", _W + ", o(field, down) AS (VALUES " + ", ".join(f"('{f}', {down})" for f, down in _OPTIONS) + "), f AS (SELECT arg_min(doc_id, (price, doc_id)) AS p, arg_min(doc_id, (-price, doc_id)) AS pd, arg_min(doc_id, (size, doc_id)) AS s, arg_min(doc_id, (-size, doc_id)) AS sd FROM items) SELECT field, down, field = 'price' AND down AS active, 'q=x&sort=' || CASE WHEN down THEN '-' ELSE '' END || field AS link, CASE field WHEN 'price' THEN CASE WHEN down THEN pd ELSE p END ELSE CASE WHEN down THEN sd ELSE s END END AS first_id FROM o, f")
def srt_options(spark, d):
    """The sort options of a result, with links, and the product that each would put first; one scan for all."""
    active = {(s.field, s.descending) for s in params.parse_sort("-price", FIELDS)}
    numbers = [f.name for f in FIELDS.fixed if "SORT" in f.usage and f.type == "NUMBER"]
    options = [(n, down) for n in numbers for down in (True, False)]
    first = lambda n, down: F.min_by("doc_id", F.struct(-F.col(n) if down else F.col(n), "doc_id"))
    entry = [F.struct(F.lit(n).alias("field"), F.lit(down).alias("down"), F.lit((n, down) in active).alias("active"), F.lit(search.links({"q": "x"}, sort=f"{'-' if down else ''}{n}")).alias("link"), first(n, down).alias("first_id")) for n, down in options]
    return C.items(spark, d).agg(F.array(*entry).alias("options")).select(F.inline("options"))


@query("lim_page", _W + "SELECT doc_id, title FROM items ORDER BY price DESC, doc_id LIMIT 12 OFFSET 24")
def lim_page(spark, d):
    limit, offset = params.page(None, 24)
    return K.page(C.items(spark, d), [F.col("price").desc(), F.col("doc_id")], limit, offset).select("doc_id", "title")


_PICK = "v AS (SELECT *, stock AS score, count(*) OVER (PARTITION BY doc_id) AS n_variants FROM variants), m AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt, count(*) OVER (PARTITION BY doc_id) AS hits FROM v WHERE color = 'R' WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, variant_pos))"


def _matching_variants(spark, d):
    n = C.variants(spark, d, False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_variants"))
    return C.variants(spark, d).filter("color = 'R'").withColumn("score", F.col("stock")).join(n, "doc_id")


@query("var_pick", _W + f", {_PICK} SELECT doc_id, variant_pos FROM m WHERE r = 1 AND (hits = 1 OR score > nxt)")
def var_pick(spark, d):
    return K.pick_variant(_matching_variants(spark, d))


@query("var_prefer_on_filter", _W + f", {_PICK} SELECT doc_id, variant_pos FROM m WHERE r = 1")
def var_prefer_on_filter(spark, d):
    preferred, filters = {"color"}, [Filter("color", values=("r",))]
    return K.pick_variant(_matching_variants(spark, d), "pickAlways" if preferred & {f.field for f in filters} else "pickIfBestScored")


@query("var_overlay", _W + "SELECT i.doc_id, i.title, coalesce(CAST(v.price AS VARCHAR), CAST(i.price AS VARCHAR)) AS price FROM items i LEFT JOIN variants v ON v.doc_id = i.doc_id AND variant_pos = 0")
def var_overlay(spark, d):
    from ..functions.scalars import map_overlay

    master = C.items(spark, d).select("doc_id", F.create_map(F.lit("title"), F.col("title"), F.lit("price"), F.col("price").cast("string")).alias("m"))
    v = C.variants(spark, d).filter("variant_pos = 0").select("doc_id", F.create_map(F.lit("price"), F.col("price").cast("string")).alias("v"))
    out = map_overlay(F.col("m"), F.coalesce("v", F.create_map().cast("map<string,string>")))
    return master.join(v, "doc_id", "left").select("doc_id", out["title"].alias("title"), out["price"].alias("price"))


@query("var_price_prefix", _W + f", {_ENDS} SELECT doc_id, CASE WHEN price_lo < price_hi THEN 'from' END AS prefix FROM e")
def var_price_prefix(spark, d):
    ends = C.variants(spark, d, False).groupBy("doc_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return ends.select("doc_id", K.price_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


# --- relaxation, sets, arrangement -------------------------------------------

STAGES = [search.Stage("phrase", "phrase"), search.Stage("all", "all"), search.Stage("relaxed", "relaxed"), search.Stage("fuzzy", "fuzzy")]


def _searched(spark, d, q, **options):
    x = titled(spark, d)
    return search.staged_search(x, tok(), SearchRequest(q), STAGES, **options)


@query("rlx_staged", _W + "SELECT doc_id, 'all' AS strategy FROM items WHERE title = 'red bolt'")
def rlx_staged(spark, d):
    r = _searched(spark, d, "bolt red")
    return r.hits.select("doc_id", F.lit(r.meta["strategy"]).alias("strategy"))


@query("rlx_sufficient", _W + f", b AS (SELECT doc_id, title FROM items WHERE brand = 'Brand#11'), p AS (SELECT doc_id FROM b WHERE title = 'red bolt') SELECT doc_id, CASE WHEN (SELECT count(*) FROM p) > 12 THEN 'phrase' ELSE 'any' END AS strategy FROM b WHERE CASE WHEN (SELECT count(*) FROM p) > 12 THEN title = 'red bolt' ELSE list_contains({_T}, 'red') OR list_contains({_T}, 'bolt') END")
def rlx_sufficient(spark, d):
    # All hits of the phrase are heroes, and there is a filter: only a full page of them would do.
    request = SearchRequest("red bolt", [Filter("brand", values=("brand#11",))])
    x = titled(spark, d).filter("brand = 'Brand#11'")
    heroes = x.filter("title = 'red bolt'").select("doc_id")
    r = search.staged_search(x, tok(), request, [STAGES[0], search.Stage("any", "any")], heroes=100_000, hero_ids=heroes)
    return r.hits.select("doc_id", F.lit(r.meta["strategy"]).alias("strategy"))


@query("rlx_fallback", _W + f"SELECT doc_id FROM items WHERE len(list_filter({_T}, lambda w: levenshtein(w, 'gizmoz') <= 2)) > 0")
def rlx_fallback(spark, d):
    stages = [STAGES[0], search.Stage("predicted", "predicted", fallback=search.Stage("fuzzy", "fuzzy"))]
    return search.staged_search(titled(spark, d), tok(), SearchRequest("gizmoz"), stages).hits.select("doc_id")


@query("rlx_correct_retry", _W + "SELECT doc_id, 'phrase' AS strategy FROM items WHERE title = 'small widget'")
def rlx_correct_retry(spark, d):
    words = titled(spark, d).select(F.explode(tok()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    r = _searched(spark, d, "small widgat", dictionary=words)
    return r.hits.select("doc_id", F.lit(r.meta["strategy"]).alias("strategy"))


@query("rlx_jump", _W + f"SELECT doc_id FROM items WHERE list_contains({_T}, 'red') AND list_contains({_T}, 'bolt')")
def rlx_jump(spark, d):
    return _searched(spark, d, "red bolt", only=1).hits.select("doc_id")


@query("rlx_invalid", _W + "SELECT doc_id FROM items WHERE false")
def rlx_invalid(spark, d):
    return _searched(spark, d, "   ").hits.select("doc_id")


@query("set_union_should", _W + f"SELECT doc_id, CAST(list_contains({_T}, 'red') AS DOUBLE) * 2 + CAST(list_contains({_T}, 'bolt') AS DOUBLE) AS score FROM items WHERE score > 0")
def set_union_should(spark, d):
    x = titled(spark, d)
    return M.union_should([x.filter(M.has(tok(), t)).withColumn("score", F.lit(w)) for t, w in (("red", 2.0), ("bolt", 1.0))])


@query("set_and_merge", _W + f"SELECT doc_id, 3.0 AS score FROM items WHERE list_contains({_T}, 'red') AND list_contains({_T}, 'bolt')")
def set_and_merge(spark, d):
    hit, score = M.and_merge([(M.has(tok(), t), F.lit(w)) for t, w in (("red", 2.0), ("bolt", 1.0))])
    return titled(spark, d).filter(hit).select("doc_id", score.alias("score"))


@query("set_dedupe_ids", f"WITH {_SETS} SELECT k AS doc_id, CAST(p[1] AS INTEGER) AS set_no FROM f")
def set_dedupe_ids(spark, d):
    one, two = _sets(spark, d)
    later = two.join(one, "doc_id", "left_anti")
    return one.select("doc_id", F.lit(0).alias("set_no")).union(later.select("doc_id", F.lit(1)))


def _resolved(spark, d, *sets, registry=None):
    found = prodsets.resolve(list(sets), titled(spark, d), tok(), _fields(), registry)
    return reduce(DataFrame.unionByName, [f.withColumn("set_no", F.lit(i)) for i, f in enumerate(found)])


@query("arr_static", _W + ", a AS (SELECT doc_id, row_number() OVER (ORDER BY CASE doc_id WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END) - 1 AS pos FROM items WHERE doc_id IN (9, 3, 7)), b AS (SELECT doc_id, row_number() OVER (ORDER BY CASE title WHEN 'red bolt' THEN 0 ELSE 1 END, doc_id) - 1 AS pos FROM items WHERE title IN ('red bolt', 'old gear') AND doc_id NOT IN (9, 3, 7)) SELECT doc_id, 0 AS set_no, pos FROM a UNION ALL SELECT doc_id, 1, pos FROM b")
def arr_static(spark, d):
    by_title = prodsets.ProductSet("static", ids=("red bolt", "old gear", "no such title"), field="title")
    return _resolved(spark, d, prodsets.ProductSet("static", ids=(9, 3, -5, 9, 7)), by_title).select("doc_id", "set_no", "pos")


_DYNAMIC = f"a AS (SELECT doc_id, row_number() OVER (ORDER BY price DESC, doc_id) - 1 AS pos FROM items WHERE list_contains({_T}, 'bolt') QUALIFY pos < 3), b AS (SELECT doc_id, row_number() OVER (ORDER BY size, doc_id) - 1 AS pos FROM items WHERE list_contains({_T}, 'bolt') AND doc_id NOT IN (SELECT doc_id FROM a) QUALIFY pos < 5)"


@query("arr_dynamic", _W + f", {_DYNAMIC} SELECT doc_id, 0 AS set_no, pos FROM a UNION ALL SELECT doc_id, 1, pos FROM b")
def arr_dynamic(spark, d):
    one = prodsets.ProductSet("dynamic", query="bolt", sort=(("price", True),))
    return _resolved(spark, d, one, prodsets.ProductSet("dynamic", query="bolt", sort=(("size", False),), limit=5)).select("doc_id", "set_no", "pos")


@query("arr_querystring", _W + f"SELECT doc_id, row_number() OVER (ORDER BY 3.0 * CAST(list_contains({_T}, 'gear') AS INTEGER) + CAST(lower(brand) = 'brand#11' AS INTEGER) DESC, doc_id) - 1 AS pos FROM items WHERE (list_contains({_T}, 'gear') OR lower(brand) = 'brand#11') AND NOT list_contains({_T}, 'old') QUALIFY pos < 3")
def arr_querystring(spark, d):
    return _resolved(spark, d, prodsets.ProductSet("querystring", query="gear brand#11 -old", weights={"title": 3.0, "brand": 1.0})).select("doc_id", "pos")


@query("arr_generic", _W + "SELECT doc_id, row_number() OVER (ORDER BY size DESC, doc_id) - 1 AS pos FROM items QUALIFY pos < 2")
def arr_generic(spark, d):
    from .extensions import Registry

    r = Registry()
    r.add("product_set", "largest", lambda s, docs, used: K.positions(docs.orderBy(F.col("size").desc(), "doc_id").limit(s.limit), [F.col("size").desc(), F.col("doc_id")], 0))
    # A kind without a plug-in has no ids.
    return _resolved(spark, d, prodsets.ProductSet("unknown"), prodsets.ProductSet("largest", limit=2), registry=r).select("doc_id", "pos")


@query("arr_slices", _W + f", {_SETS} SELECT CASE coalesce(p[1], 2) WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'main' END AS slice, count(*) AS n FROM items LEFT JOIN f ON k = doc_id GROUP BY ALL")
def arr_slices(spark, d):
    a = K.arrange(C.items(spark, d).select("doc_id"), _sets(spark, d))
    return a.groupBy(F.when(F.col("set_no") == 0, "first").when(F.col("set_no") == 1, "second").otherwise("main").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("lnk_build", _W + "SELECT brand AS value, count(*) AS doc_count, brand = 'Brand#11' AS selected, CASE WHEN brand = 'Brand#11' THEN 'q=x' ELSE 'brand=Brand%2311%2C' || replace(brand, '#', '%23') || '&q=x' END AS link FROM items GROUP BY brand")
def lnk_build(spark, d):
    """The links of a facet's entries: each adds its value to the filter or, if it is on, takes it off."""
    entries = C.items(spark, d).groupBy(F.col("brand").alias("value")).agg(F.count(F.lit(1)).alias("doc_count"))
    link, on = search.entry_links({"q": "x", "brand": "Brand#11", "offset": "12"}, "brand", F.col("value"))
    return entries.select("value", "doc_count", on.alias("selected"), link.alias("link"))


@query("meta_label", _W + ", t AS (SELECT DISTINCT title, split_part(title, ' ', 1) AS x, split_part(title, ' ', 2) AS y FROM items), l AS (SELECT title, CASE x WHEN 'red' THEN '(red OR crimson OR scarlet^0.5)' ELSE x END || ' ' || y AS label FROM t) SELECT title AS query, label FROM l")
def meta_label(spark, d):
    """The label of each title as a query under the rules."""
    parsed = rules.parse_rules(RULES)
    own = {h[0]: graph.build(h[0], {h: some}).label() for h, some in parsed.items() if len(h) == 1 and any(x.kind == "SYNONYM" for x in some)}
    labelled = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return _titles(spark, d).select("query", F.array_join(F.transform("terms", lambda t: F.coalesce(labelled[t], t)), " ").alias("label"))


@query("meta_trace", _W + "SELECT 'bolt red' AS q, CASE WHEN count(*) FILTER (title = 'red bolt') > 0 THEN 'all' ELSE 'relaxed' END AS strategy, CASE WHEN count(*) FILTER (title = 'red bolt') > 0 THEN 2 ELSE 3 END AS queries, 'bolt red' AS terms FROM items")
def meta_trace(spark, d):
    m = search.staged_search(titled(spark, d), tok(), SearchRequest("bolt red"), STAGES, trace="Request, EsQuery,unknown").meta
    return spark.createDataFrame([(m["query"], m["strategy"], len(m["trace_query"]), " ".join(m["trace_request"]["terms"]))], "q string, strategy string, queries int, terms string")


@query("cfg_merge_search", _W + ", c AS (SELECT name, value, count(DISTINCT doc_id) AS doc_count FROM fv WHERE variant_pos IS NULL AND name IN ('brand', 'type') GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_count DESC, value) <= CASE name WHEN 'brand' THEN 4 ELSE 2 END")
def cfg_merge_search(spark, d):
    """Facets as a tenant's configuration, merged with the defaults, asks for them."""
    from pyspark.sql import Window

    defaults = {"facets": [{"name": "type", "limit": 2}, {"name": "brand", "limit": 9}], "scoring": {"mode": "avg"}}
    got = search.merge_config(defaults, {"facets": [{"name": "brand", "limit": 4}], "scoring": None}, {"scoring": False})
    assert got["scoring"] is None
    limits = {f["name"]: f["limit"] for f in got["facets"]}
    counted = C.facet_values(C.items(spark, d)).filter(F.col("name").isin(*limits)).groupBy("name", "value").agg(F.countDistinct("doc_id").alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("doc_count").desc(), "value"))
    most = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for n, k in limits.items()])
    return counted.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


@query("cfg_merge_index", _W + "SELECT level, count(*) AS n, min(value) AS lo, max(value) AS hi FROM (SELECT 'MASTER' AS level, price AS value FROM items UNION ALL SELECT 'VARIANT', price FROM variants) GROUP BY level")
def cfg_merge_index(spark, d):
    """A field that two indexes have on different levels is read on both, with both usages."""
    from ..schema import Field, FieldIndex

    merged = FieldIndex([Field("price", "NUMBER", usage=("FACET",))]).merged(FieldIndex([Field("price", "NUMBER", level="VARIANT", usage=("SEARCH",))])).match("price")[0]
    sides = ([("MASTER", C.items(spark, d))] if merged.on_master else []) + ([("VARIANT", C.variants(spark, d, False))] if merged.on_variant else [])
    values = reduce(DataFrame.unionByName, [x.select(F.lit(level).alias("level"), F.col(merged.name).cast("double").alias("value")) for level, x in sides])
    return values.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


# --- suggest -----------------------------------------------------------------


def records(spark, d):
    own = C.items(spark, d).groupBy(F.col("title").alias("text")).agg(F.count(F.lit(1)).alias("weight"), F.min("type").alias("secondary"))
    return own.withColumn("tags", F.array(F.lit("product")))


_SUG = """, t AS (SELECT title AS text, count(*) AS weight, min(type) AS secondary FROM items GROUP BY title),
 s AS (SELECT text, weight, CASE WHEN text = 'old gear' THEN 0 WHEN text LIKE 'wid%' OR contains(text, ' wid') THEN 1 WHEN lower(secondary) LIKE 'wid%' OR contains(lower(secondary), ' wid') THEN 2
  WHEN len(list_filter(string_split(text, ' '), lambda w: levenshtein(left(w, 4), 'wid') <= 1)) > 0 THEN 3 WHEN len(list_filter(string_split(text, ' '), lambda w: levenshtein(left(w, 5), 'wid') <= 2)) > 0 THEN 4
  WHEN contains(replace(text, ' ', ''), 'wid') THEN 5 WHEN text = 'red bolt' THEN 6 END AS stage FROM t)
 SELECT text, stage, weight FROM s WHERE stage IS NOT NULL AND (stage <> 4 OR (SELECT min(stage) FROM s) = 4)"""


@query("sug_api", _W + _SUG.replace("'old gear'", "'-'").replace("'red bolt'", "'-'").replace("wid", "bol"))
def sug_api(spark, d):
    return G.suggest(records(spark, d), "bol", 1000, "product")


@query("sug_stages", _W + _SUG)
def sug_stages(spark, d):
    return G.suggest(records(spark, d), "wid", 1000, sharpened={"wid": ["old gear"]}, relaxed={"wid": ["red bolt"]})


_CC = "CASE WHEN title = 'red bolt' THEN 1.0 ELSE round(list_sum(list_transform(['b','d','e','l','o','r','t'], lambda a: least(len(list_filter(string_split(replace(title, ' ', ''), ''), lambda x: x = a)), 1))) / greatest(length(replace(title, ' ', '')), 7), 6) END"


@query("sug_common_chars", _W + f"SELECT DISTINCT title, {_CC} AS v FROM items")
def sug_common_chars(spark, d):
    return C.items(spark, d).select("title").distinct().select("title", F.round(G.common_chars(F.col("title"), "red bolt"), 6).alias("v"))


_PRE = "list_max(list_transform(range(0, 5), lambda k: CASE WHEN left({0}, k) = left('bolt', k) THEN k ELSE 0 END))"


@query("sug_prefix_len", _W + f"SELECT DISTINCT title, CAST(CASE WHEN {_PRE.format('title')} > 0 THEN {_PRE.format('title')} ELSE {_PRE.format("split_part(title, ' ', 2)")} END AS INTEGER) AS v FROM items")
def sug_prefix_len(spark, d):
    return C.items(spark, d).select("title").distinct().select("title", G.prefix_length(F.col("title"), "bolt").alias("v"))


def _ranked(spark, d, order):
    x = records(spark, d).withColumn("prefix", G.prefix_length(F.col("text"), "bolt")).withColumn("common", G.common_chars(F.col("text"), "bolt")).withColumn("stage", F.lit(1))
    return K.positions(x, order).select("text", "weight", F.col("pos").cast("int").alias("pos"))


_LETTERS = "least(len(list_filter(string_split(replace(text, ' ', ''), ''), lambda x: x = '{0}')), 1)"
_BOLT = (
    f"CAST(CASE WHEN {_PRE.format('text')} > 0 THEN {_PRE.format('text')} ELSE greatest({_PRE.format("split_part(text, ' ', 2)")}, 0) END AS INTEGER) AS prefix, "
    + "CASE WHEN text = 'bolt' THEN 1.0 ELSE (" + " + ".join(_LETTERS.format(x) for x in "bolt") + ") / greatest(length(replace(text, ' ', '')), 4) END AS common"
)


@query("sug_fuzzy_order", _W + f", t AS (SELECT title AS text, count(*) AS weight FROM items GROUP BY title), r AS (SELECT text, weight, {_BOLT} FROM t) SELECT text, weight, CAST(row_number() OVER (ORDER BY prefix DESC, common DESC, weight DESC, text) AS INTEGER) AS pos FROM r")
def sug_fuzzy_order(spark, d):
    return _ranked(spark, d, G.fuzzy_order("text", "bolt"))


@query("sug_default_order", _W + f", t AS (SELECT title AS text, count(*) AS weight FROM items GROUP BY title), r AS (SELECT text, weight, {_BOLT} FROM t) SELECT text, weight, CAST(row_number() OVER (ORDER BY weight DESC, common DESC, text) AS INTEGER) AS pos FROM r")
def sug_default_order(spark, d):
    return _ranked(spark, d, G.default_order("text"))


@query("sug_topk", _W + "SELECT title AS text, count(*) AS weight FROM items GROUP BY title ORDER BY weight DESC, text LIMIT 5")
def sug_topk(spark, d):
    return records(spark, d).orderBy(F.col("weight").desc(), "text").limit(5).select("text", "weight")


def _grouped(spark, d):
    x = C.items(spark, d)
    a = x.groupBy(F.upper("title").alias("text")).agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", F.lit("log"))
    return a.unionByName(x.groupBy(F.col("title").alias("text")).agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", F.lit("catalog")))


@query("sug_group_limit", _W + ", g AS (SELECT upper(title) AS text, count(*) AS weight, 'log' AS kind FROM items GROUP BY title UNION ALL SELECT title, count(*), 'catalog' FROM items GROUP BY title) SELECT text, weight, kind FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY weight DESC, text) <= CASE kind WHEN 'log' THEN 7 ELSE 3 END")
def sug_group_limit(spark, d):
    return G.group_limit(_grouped(spark, d), "kind", {"log": 0.7, "catalog": 0.3}, 10)


_THREE = "SELECT upper(title) AS text, count(*) AS weight, 'log' AS kind FROM items GROUP BY title UNION ALL SELECT title, count(*), 'catalog' FROM items GROUP BY title UNION ALL SELECT brand, count(*), 'brand' FROM items WHERE brand IN ('Brand#11', 'Brand#12') GROUP BY brand"


@query("sug_share_limit", _W + f", g AS ({_THREE}) SELECT text, weight, kind FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY weight DESC, text) <= CASE kind WHEN 'log' THEN 11 WHEN 'catalog' THEN 7 ELSE 2 END")
def sug_share_limit(spark, d):
    """Three groups of which one can't fill its share of four: the two places left go to the others."""
    brands = C.items(spark, d).filter(F.col("brand").isin("Brand#11", "Brand#12")).groupBy(F.col("brand").alias("text")).agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", F.lit("brand"))
    return G.group_limit(_grouped(spark, d).unionByName(brands), "kind", {"log": 0.5, "catalog": 0.3, "brand": 0.2}, 20)


@query("sug_prefix_batch", _W + """, r AS (SELECT title AS text, min(type) AS secondary, count(*) AS weight FROM items GROUP BY title), w AS (SELECT DISTINCT unnest(string_split(title, ' ') || [title]) AS w FROM items),
q AS (SELECT DISTINCT left(w, n) AS query FROM w, range(1, 12) t(n)),
m AS (SELECT query, text, weight, CASE WHEN starts_with(text, query) OR contains(text, ' ' || query) THEN 1 WHEN starts_with(lower(secondary), trim(query)) OR contains(lower(secondary), ' ' || trim(query)) THEN 2 END AS stage FROM q, r)
SELECT query, text, stage, weight, row_number() OVER (PARTITION BY query ORDER BY stage, weight DESC, text) AS rank FROM m WHERE stage IS NOT NULL QUALIFY rank <= 5""")
def sug_prefix_batch(spark, d):
    """Everything a user may have typed of a word or a title, answered from a stored index by one join."""
    from ..operators import suggest_index as Q

    stored = scratch.keep(Q.index(records(spark, d).select("text", "secondary", "weight")), "suggest")
    typed = F.explode(F.array_append(F.split("title", " "), F.col("title"))).alias("w")
    asked = C.items(spark, d).select("title").distinct().select(typed).distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("query"))
    return Q.lookup(stored, asked.distinct(), 5).select("query", "text", "stage", "weight", F.col("rank").cast("long").alias("rank"))


@query("sug_dedupe", _W + "SELECT title AS text, 'catalog' AS kind, count(*) AS weight FROM items GROUP BY title")
def sug_dedupe(spark, d):
    return G.dedupe(_grouped(spark, d), "kind", ["catalog", "log"])


@query("sug_source", _W + "SELECT brand AS text, count(*) AS weight FROM items GROUP BY brand ORDER BY weight DESC, text LIMIT 1000")
def sug_source(spark, d):
    return G.source(C.facet_values(C.items(spark, d)), "brand")

"""Queries of whole requests and indexings with plug-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import preprocess as R
from ..operators import ranking as K
from ..operators import store
from ..sources import catalog as C
from ..sources import scratch
from . import prodsets, request, rules
from .extensions import Registry
from .params import SearchRequest, Sort
from .q_ingest import docs as documents
from .q_search import _SETS, _T, _W, RULES, _fields, _sets, titled, tok
from .registry import query
from .search import Stage


class Translated:
    """A query preprocessor: words by a configured table."""

    def initialize(self, settings: dict[str, str]) -> None:
        self.words = settings

    def __call__(self, q: str, meta: dict) -> str:
        new = " ".join(self.words.get(w, w) for w in q.lower().split())
        meta["translated"] = new != q
        return new


class Parity:
    """A rescorer: products of one brand gain by their size; the window is a request's."""

    def initialize(self, settings: dict[str, str]) -> None:
        self.brand = settings["brand"]

    def __call__(self, q: str, custom: dict[str, str]) -> K.Rescorer | None:
        if "window" not in custom:
            return None
        return K.Rescorer(int(custom["window"]), F.col("brand") == self.brand, F.col("size").cast("double"), 0.5, 2.0)


def _registry() -> Registry:
    r = Registry()
    r.add("query_preprocessor", "translated", Translated)
    r.add("query_analyzer", "rules", lambda q: rules.rewrite(q, rules.parse_rules(RULES)))
    r.add("query_factory", "priced", lambda docs, tokens, terms: docs.filter(reduce(lambda a, b: a & b, [M.has(tokens, t) for t in terms])).withColumn("score", F.col("price")))
    r.add("rescorer", "brand", Parity)
    r.add("rescorer", "short", lambda q, custom: K.Rescorer(5, F.lit(True), F.lit(1000.0), 0.1, 9.0))
    r.add("config", "priced first", lambda tenant, config: config | {"stages": [Stage("priced", "priced"), *config["stages"]]})
    return r


_CONFIG = {
    "stages": [Stage("any", "any"), Stage("unknown", "no such factory")], "query_preprocessors": ["translated", "no such plug-in"], "rescorers": ["brand", "short"],
    "plugins": {"translated": {"bolzen": "bolt"}, "brand": {"brand": "Brand#11"}},
}


@query("ext_query_plugins", _W + f""", x AS (SELECT doc_id, (price + CASE WHEN list_contains({_T}, 'new') THEN 2.0 ELSE 0.0 END) * CASE WHEN list_contains({_T}, 'old') THEN 0.5 ELSE 1.0 END AS score FROM items WHERE list_contains({_T}, 'bolt') AND brand = 'Brand#11'),
y AS (SELECT doc_id, score * 0.1 + CASE WHEN row_number() OVER (ORDER BY score DESC, doc_id) <= 5 THEN 9000.0 ELSE 0.0 END AS score FROM x) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS "at", count(*) OVER () AS match_count, 'priced' AS strategy FROM y QUALIFY "at" < 50""")
def ext_query_plugins(spark, d):
    """A page of a request whose text is translated, analyzed by rules, searched and rescored by plug-ins.

    There are no heroes, so the rescorer of five hits counts; the other has no window and isn't made."""
    service = request.Service.configure("shop", _CONFIG | {"query_analyzer": "rules"}, _registry())
    x = titled(spark, d)
    got = service.find(x, C.facet_values(C.items(spark, d)), tok(), SearchRequest("Bolzen", limit=50))
    return got.page.select("doc_id", F.round("score", 6).alias("score"), F.col("at").cast("long").alias("at"), "match_count", F.lit(got.meta["strategy"]).alias("strategy"))


@query("sco_rescore_rules", _W + f""", {_SETS}, b AS (SELECT doc_id, brand, size, p IS NOT NULL AS hero, CASE WHEN p IS NULL THEN 0.0 ELSE 10.0 * CASE p[1] WHEN 0 THEN 1000.0 ELSE 1.0 END * greatest(1000 - p[2], 1) END AS own, greatest(price, own) AS score FROM items LEFT JOIN f ON k = doc_id),
w AS (SELECT count(*) + 50 AS n FROM l), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b), s AS (SELECT doc_id, hero, own, score * 0.5 + CASE WHEN r <= n AND brand = 'Brand#11' THEN size * 2.0 ELSE 0.0 END AS score FROM r, w),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s) SELECT doc_id, round(score + CASE WHEN r <= n AND hero THEN own * 1.5 ELSE 0.0 END, 4) AS score FROM t, w""")
def sco_rescore_rules(spark, d):
    """All products, rescored in a window beyond the heroes, which get back what the rescorer takes from them.

    A rescorer whose window ends within the heroes is left out."""
    sets = _sets(spark, d)
    heroes = sum(s.count() for s in sets)
    service = request.Service.configure("shop", _CONFIG, _registry())
    hits = K.hero_boost(C.items(spark, d).withColumn("score", F.col("price")), sets)
    some = service.rescorers_for(SearchRequest("x", custom={"window": str(heroes + 50)}))
    return K.rescored(hits, some, len(sets), heroes).select("doc_id", F.round("score", 4).alias("score"))


_ARRANGED = f"""h AS (SELECT doc_id, 0 AS set_no, row_number() OVER (ORDER BY CASE doc_id WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END) - 1 AS pos FROM items WHERE doc_id IN (9, 3, 7)),
g AS (SELECT doc_id, 1 AS set_no, row_number() OVER (ORDER BY price DESC, doc_id) - 1 AS pos FROM items WHERE list_contains({_T}, 'gear') AND doc_id NOT IN (SELECT doc_id FROM h) QUALIFY pos < 5),
x AS (SELECT doc_id, price, coalesce(set_no, 2) AS set_no, CASE set_no WHEN 0 THEN 10000.0 * (1000 - pos) WHEN 1 THEN 10.0 * (1000 - pos) ELSE price END AS score FROM items LEFT JOIN (FROM h UNION ALL FROM g) USING (doc_id) WHERE set_no IS NOT NULL OR list_contains({_T}, 'bolt')),
n AS (SELECT set_no, count(*) AS n FROM x GROUP BY set_no), y AS (SELECT *, ['first', 'second', 'main'][set_no + 1] AS slice FROM x JOIN n USING (set_no))
SELECT 'all' AS request, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS "at", slice, n AS match_count FROM y QUALIFY "at" < 40
UNION ALL SELECT 'sets', doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1, slice, n FROM y WHERE set_no < 2
UNION ALL SELECT 'sorted', doc_id, row_number() OVER (ORDER BY price, score DESC, doc_id) - 1 AS "at", 'main', count(*) OVER () FROM y QUALIFY "at" < 40"""


@query("arr_slices_request", _W + f", {_ARRANGED}")
def arr_slices_request(spark, d):
    """Pages of three arranged requests: with the main result, without it, and sorted, which has no slices of sets."""
    sets = [prodsets.ProductSet("static", "first", ids=(9, 3, -5, 7), separate=True), prodsets.ProductSet("dynamic", "second", query="gear", sort=(("price", True),), limit=5, separate=True)]
    service = request.Service.configure("shop", _CONFIG, _registry())
    x = titled(spark, d).withColumn("price_lo", F.col("price")).withColumn("price_hi", F.col("price"))
    values = C.facet_values(C.items(spark, d))
    asked = {"all": SearchRequest("bolzen", limit=40), "sets": SearchRequest("bolzen", limit=40, include_main=False), "sorted": SearchRequest("bolzen", sort=[Sort("price")], limit=40)}
    pages = [service.find(x, values, tok(), r, sets, _fields()).page.withColumn("request", F.lit(name)) for name, r in asked.items()]
    return reduce(DataFrame.unionByName, pages).select("request", "doc_id", F.col("at").cast("long").alias("at"), "slice", "match_count")


class Skipping:
    """A preprocessor: documents go whose field matches; it keeps how the indexing ended."""

    def initialize(self, settings: dict[str, str]) -> None:
        self.settings, self.ended = settings, None

    def __call__(self, docs: DataFrame) -> DataFrame:
        return R.skip_documents(docs, self.settings["field"], self.settings["pattern"])

    def finish(self, success: bool) -> None:
        self.ended = success


@query("ext_index_plugins", _W + "SELECT doc_id, upper(title) AS title, true AS first, false AS second FROM items WHERE size NOT BETWEEN 10 AND 19")
def ext_index_plugins(spark, d):
    """Documents indexed through plug-ins; a second indexing has too few documents and is cancelled."""
    r = Registry()
    r.add("preprocessor", "skipping", Skipping)
    r.add("postprocessor", "shout", lambda df: df.withColumn("title", F.upper("title")))
    kept, ends = store.Store(spark, scratch.folder(spark, "store")), []
    project = lambda x: x.select("doc_id", F.get(F.element_at("data", "title"), F.lit(0)).alias("title"))
    for pattern, minimum in (("1[0-9]", 1), (".*", 1)):
        plugins = r.configured("preprocessor", ["skipping"], {"skipping": {"field": "size", "pattern": pattern}})
        request.index(documents(spark, d), project, kept, kept.start("parts", "en"), plugins, r.configured("postprocessor", ["shout"]), minimum)
        ends.append(plugins["skipping"].ended)
    return kept.read("parts-en").select("doc_id", "title", F.lit(ends[0]).alias("first"), F.lit(ends[1]).alias("second"))

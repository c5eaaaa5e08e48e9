"""Whole requests: plug-ins, rescoring, slices; and how an indexing ends."""

import pytest
from pyspark.sql import functions as F

from stockweave.operators import ranking as K
from stockweave.operators import store
from stockweave.plans import extensions, prodsets, request
from stockweave.plans.params import Filter, SearchRequest, Sort
from stockweave.plans.search import Stage


def catalog(spark):
    rows = [(1, "red bolt", 5.0), (2, "red gear", 7.0), (3, "old gear", 9.0), (4, "old bolt", 1.0), (5, "new rod", 3.0)]
    x = spark.createDataFrame(rows, "doc_id long, title string, price double")
    x = x.withColumn("tokens", F.split("title", " ")).withColumn("price_lo", F.col("price")).withColumn("price_hi", F.col("price"))
    none = F.lit(None)
    word = F.explode("tokens").alias("value_norm")
    values = x.select("doc_id", none.cast("int").alias("variant_pos"), F.lit("word").alias("name"), word, none.cast("double").alias("num_value"))
    return x, values


def service(registry=None, **config):
    return request.Service.configure("shop", {"stages": [Stage("all", "all")], **config}, registry or extensions.Registry())


def found(spark, s, r, *sets):
    x, values = catalog(spark)
    got = s.find(x, values, F.col("tokens"), r, list(sets), {"title": F.col("tokens")})
    return [(p.doc_id, p.slice, p.match_count) for p in got.page.orderBy("at").collect()], got.meta


def static(*ids, **more):
    return prodsets.ProductSet("static", "top", ids=ids, **more)


def test_pages_and_slices(spark):
    s = service()
    assert found(spark, s, SearchRequest("bolt"))[0] == [(1, "main", 2), (4, "main", 2)]
    assert found(spark, s, SearchRequest("bolt"), static(5, 4, separate=True))[0] == [(5, "top", 2), (4, "top", 2), (1, "main", 1)]
    assert found(spark, s, SearchRequest("bolt"), static(5, 4))[0] == [(5, "main", 3), (4, "main", 3), (1, "main", 3)]
    assert found(spark, s, SearchRequest("bolt", limit=1, offset=1), static(5, separate=True))[0] == [(1, "main", 2)]
    assert found(spark, s, SearchRequest("bolt", sort=[Sort("price")]), static(5, separate=True))[0] == [(4, "main", 3), (5, "main", 3), (1, "main", 3)]


def test_without_the_main_result(spark):
    s = service()
    assert found(spark, s, SearchRequest("bolt", include_main=False), static(5, 4, separate=True)) == ([(5, "top", 2), (4, "top", 2)], {"include_main": False})
    assert found(spark, s, SearchRequest("bolt", include_main=False), static(5, 4))[0] == []
    assert found(spark, s, SearchRequest("bolt", include_main=False))[0] == []


def test_filters_reach_product_sets(spark):
    r = SearchRequest("bolt", [Filter("word", values=("red",))])
    assert [d for d, _, _ in found(spark, service(), r, static(5, 2, separate=True))[0]] == [2, 1]


def test_stages_of_factories_and_heroes(spark):
    registry = extensions.Registry()
    registry.add("query_factory", "nothing", lambda docs, tokens, terms: None)
    registry.add("query_factory", "cheap", lambda docs, tokens, terms: docs.filter("price < 2").withColumn("score", 1 / F.col("price")))
    s = service(registry, stages=[Stage("x", "missing"), Stage("nothing", "nothing"), Stage("cheap", "cheap"), Stage("all", "all")])
    assert [x.name for x in s.stages] == ["nothing", "cheap", "all"]
    got, meta = found(spark, s, SearchRequest("bolt"))
    assert got == [(4, "main", 1)] and meta["strategy"] == "cheap"
    # The only hit is a hero, which doesn't suffice: the next stage is asked.
    got, meta = found(spark, s, SearchRequest("bolt"), static(4))
    assert [d for d, _, _ in got] == [4, 1] and meta["strategy"] == "all"


def test_blank_queries_and_queries_that_are_all_filter(spark):
    registry = extensions.Registry()
    registry.add("query_analyzer", "filters", lambda q: request.Analyzed([], filters=[Filter("word", values=(q,), induced=True)]))
    assert found(spark, service(), SearchRequest("  ")) == ([], {"preprocessed": "  ", "analyzed": "", "error": "blank query"})
    assert [d for d, _, _ in found(spark, service(registry, query_analyzer="filters"), SearchRequest("old"))[0]] == [3, 4]
    assert len(found(spark, service(), SearchRequest(""))[0]) == 5


def test_plugins_that_fail_are_left_out(spark):
    class Broken:
        def initialize(self, settings):
            raise ValueError(settings)

    class Loud:
        def __init__(self):
            self.end = ""

        def initialize(self, settings):
            self.end = settings["end"]

        def __call__(self, q, meta):
            return q + self.end

    calls = []

    def failing(q, custom):
        calls.append(q)
        raise RuntimeError

    registry = extensions.Registry(disabled=("off",))
    registry.add("query_preprocessor", "broken", Broken)
    registry.add("query_preprocessor", "loud", Loud)
    registry.add("query_preprocessor", "off", lambda q, meta: "gear")
    registry.add("rescorer", "failing", failing)
    registry.add("rescorer", "cheap", lambda q, custom: K.Rescorer(9, F.lit(True), -F.col("price")))
    s = service(registry, query_preprocessors=["broken", "loud", "off", "none"], plugins={"loud": {"end": " red"}}, rescorers=["failing", "cheap"], stages=[Stage("any", "any")])
    assert list(s.preprocessors) == ["loud"]
    got, meta = found(spark, s, SearchRequest("bolt"))
    assert meta["preprocessed"] == "bolt red" and [d for d, _, _ in got] == [4, 1, 2]
    found(spark, s, SearchRequest("bolt"))
    assert calls == ["bolt"] and list(s.rescorers) == ["cheap"]
    assert s.rescorers_for(SearchRequest("bolt", sort=[Sort("price")])) == []


def test_rescorers_by_brute_force(spark):
    rows = [(i, float((i * 7) % 10), i % 3 == 0, float(i % 5)) for i in range(40)]
    hits = spark.createDataFrame(rows, "doc_id long, score double, m boolean, second double")
    two = [K.Rescorer(12, F.col("m"), F.col("second"), 0.5, 3.0), K.Rescorer(7, ~F.col("m"), F.lit(4.0), 2.0, 0.25), K.Rescorer(0, F.lit(True), F.lit(99.0))]
    score = {i: s for i, s, _, _ in rows}
    for window, match, second, a, b in ((12, lambda r: r[2], lambda r: r[3], 0.5, 3.0), (7, lambda r: not r[2], lambda r: 4.0, 2.0, 0.25)):
        top = set(sorted(score, key=lambda i: (-score[i], i))[:window])
        score = {r[0]: score[r[0]] * a + (second(r) * b if r[0] in top and match(r) else 0) for r in rows}
    assert {r.doc_id: r.score for r in K.rescored(hits, two).collect()} == score


def test_heroes_stay_in_front_of_rescored_hits(spark):
    hits = spark.createDataFrame([(i, float(i)) for i in range(20)], "doc_id long, score double")
    ids = spark.createDataFrame([(3, 0), (1, 1)], "doc_id long, pos long")
    strong = K.Rescorer(10, F.col("pos").isNull(), F.lit(1.0), 0.001, 9000.0)
    weak = K.Rescorer(2, F.lit(True), F.lit(1e9))
    placed = K.hero_boost(hits, [ids])
    order = [r.doc_id for r in K.rescored(placed, [strong, weak], 1, 2).orderBy(F.col("score").desc(), "doc_id").limit(3).collect()]
    assert order == [3, 1, 19]


def test_how_an_indexing_ends(spark, tmp_path):
    told = []

    class Telling:
        def __init__(self, name):
            self.name = name

        def __call__(self, docs):
            if self.name == "fails":
                raise RuntimeError("no")
            return docs

        def finish(self, success):
            told.append((self.name, success))
            if self.name == "rude":
                raise RuntimeError("no")

    kept = store.Store(spark, f"file://{tmp_path}")
    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    run = lambda plugins, post=(), least=1: request.index(docs, lambda x: x, kept, kept.start("a", "en"), {n: Telling(n) for n in plugins}, {n: Telling(n) for n in post}, least)
    assert run(["rude"], ["last"]) and kept.live("a-en") == 1
    assert not run(["one"], least=4) and kept.live("a-en") == 1
    with pytest.raises(RuntimeError):
        run(["one", "fails"])
    assert told == [("rude", True), ("last", True), ("one", False), ("one", False), ("fails", False)]
    assert kept.versions("a-en") == [1] and kept.read("a-en").count() == 3

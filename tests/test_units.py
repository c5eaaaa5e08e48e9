"""Fixtures of the blueprint: small literal inputs and their results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockweave.functions import scalars as S
from stockweave.functions import text as X
from stockweave.operators import facets as A
from stockweave.operators import filters as P
from stockweave.operators import matching as M
from stockweave.operators import preprocess as R
from stockweave.operators import projections as J
from stockweave.operators import ranking as K
from stockweave.operators import store as T
from stockweave.operators import suggest as G
from stockweave.plans import extensions, params, rules, search
from stockweave.plans.params import Filter, SearchRequest
from stockweave.schema import Field, FieldIndex
from stockweave.streaming import updates

FIELDS = FieldIndex([
    Field("price", "NUMBER", usage=("FACET", "SORT")), Field("brand", usage=("FACET",)), Field("category", "CATEGORY", usage=("FACET",)), Field("image", usage=("RESULT",)),
])


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


# --- parameters


@pytest.mark.parametrize("text, low, high, negate", [("12,34", 12, 34, False), ("12 - 34", 12, 34, False), ("!12 - 34", 12, 34, True), ("34,12", 12, 34, False), ("7", 7, 7, False), ("10-", 10, None, False), ("-5,5", -5, 5, False)])
def test_number_filter(text, low, high, negate):
    f = params.parse_filters({"price": text}, FIELDS)[0]
    assert (f.low, f.high, f.negate) == (low, high, negate)


def test_term_filter_and_invalid_ones():
    got = params.parse_filters({"brand": "!foo,bar%2Cx,pum", "image": "x", "nope": "y", "price": "abc"}, FIELDS)
    assert len(got) == 1 and got[0].values == ("foo", "bar,x", "pum") and got[0].negate


def test_sort_and_page():
    assert [(s.field, s.descending) for s in params.parse_sort("image,-price", FIELDS)] == [("price", True)]
    assert params.page(None, None) == (12, 0) and params.page(20_000, 5) == (10_000, 0) and params.page(100, 9_950) == (100, 9_900)
    assert params.next_offset(12, 0, 13) == 12 and params.next_offset(12, 12, 24) is None


def test_merge_of_filters():
    a, b = Filter("x", values=("a",)), Filter("x", values=("b",))
    assert a.merge(b).values == ("a", "b") and a.merge(Filter("x", values=("c",), negate=True)) == a
    assert Filter("n", "number", low=1, high=5).merge(Filter("n", "number", low=3, high=9)).high == 9


# --- schema


def test_dynamic_fields_only_if_nothing_matches():
    index = FieldIndex([Field("name", source_names=("title",)), Field("label", source_names=("title",)), Field("_num$", "NUMBER", dynamic=True), Field(".", dynamic=True)])
    assert [f.name for f in index.match("title", "x")] == ["name", "label"]
    assert index.match("a_num", "12")[0].type == "NUMBER" and index.match("a_num", "x")[0].type == "STRING"


def test_raw_facets_are_rejected_and_merges_checked():
    with pytest.raises(ValueError):
        Field("x", "RAW", usage=("FACET",))
    with pytest.raises(ValueError):
        FieldIndex([Field("x", usage=("SORT",))]).merged(FieldIndex([Field("x")]))


# --- functions


@pytest.mark.parametrize("text, value", [("34", 34.0), ("4.56", 4.56), ("-.5", -0.5), ("1E-2", 0.01), ("1e3", None), ("x", None), ("", None), (None, None)])
def test_parse_number(spark, text, value):
    assert one(spark, S.parse_number, text) == value


@pytest.mark.parametrize("text, want", [("Éclair à la crème", "eclair a la creme"), ("ÄÖÜ äöü", "ÄÖÜ aou"), ("łódź ŧ", "lodz t"), (None, None)])
def test_asciify(spark, text, want):
    assert one(spark, S.asciify, text) == (want if text is None else want)


def test_short_inputs(spark):
    assert one(spark, X.ngrams, "ab") == [] and one(spark, X.ngrams, "abcd") == ["abc", "bcd"]
    assert one(spark, lambda c: X.shingle(X.words(c)), "one") == [] and one(spark, X.query_shingles, "a b c") == ["a", "ab", "b", "bc", "c"]
    assert one(spark, lambda c: X.dedupe_adjacent(X.words(c)), "a a b a") == ["a", "b", "a"]


def test_half_down_and_german(spark):
    assert one(spark, S.half_down, 1.125, "double") == 1.12 and one(spark, S.half_up, 1.125, "double") == 1.13
    assert one(spark, X.german_characters, "fußballschuhe") == "fussballschuhe"


@pytest.mark.parametrize("a, b, want", [("fool", "olf", 0.75), ("abcd", "zbdw", 0.5), ("foo", "bar", 0.0), ("Foo", "foo", 1.0)])
def test_common_chars(spark, a, b, want):
    assert one(spark, lambda c: G.common_chars(c, b), a) == want


# --- facets


def test_entry_order(spark):
    keys = ["28 z", "2 B", "Alpha", "Beta", "1 A", "4 D"]
    df = spark.createDataFrame([(k, 1) for k in keys], "value string, doc_count int")
    assert [r.value for r in df.orderBy(*A.entry_order("HUMAN_NUMERIC_ASC")).collect()] == ["1 A", "2 B", "4 D", "28 z", "Alpha", "Beta"]


@pytest.mark.parametrize("have, want", [(("a/b",), True), (("a/b/c",), True), (("x", "a/b"), True), (("a",), False), (("a/bee",), False)])
def test_dependency_on_a_path(have, want):
    assert A.dependency_met("category=a/b", {"category": have}) is want


def test_path_tree_prunes_siblings():
    tree = A.path_tree([("a", 3), ("a/b", 2), ("a/c", 1), ("d", 1)], ("a/b",))
    assert [e["key"] for e in tree] == ["a"] and [e["key"] for e in tree[0]["children"]] == ["b"]


def test_intervals_merge_until_fair(spark):
    b = spark.createDataFrame([("p", 0.0, 1), ("p", 5.0, 1), ("p", 10.0, 8)], "name string, lower double, doc_count long")
    got = A.merge_intervals(b, 5.0, 5).orderBy("lower").collect()
    assert [(r.lower, r.doc_count) for r in got] == [(0.0, 2), (10.0, 8)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 3)), min_size=1, max_size=12), st.sets(st.sampled_from("abc")), st.integers(1, 3))
def test_exclusive_facets_equal_brute_force(spark, docs, brands, size):
    values = [(i, n, v, x) for i, (b, s) in enumerate(docs) for n, v, x in (("brand", b, None), ("size", str(s), float(s)))]
    fv = spark.createDataFrame(values, "doc_id int, name string, value string, num_value double")
    sel = {"brand": F.col("value").isin(*brands) if brands else F.lit(False), "size": F.col("num_value") <= size}
    marks = A.selection_marks(spark.createDataFrame([(i,) for i in range(len(docs))], "doc_id int"), fv, sel)
    got = {(r.name, r.value): r.doc_count for r in A.exclusive_facets(fv, sel, marks).collect()}
    want = {}
    for b, s in docs:
        if s <= size:
            want["brand", b] = want.get(("brand", b), 0) + 1
        if b in brands:
            want["size", str(s)] = want.get(("size", str(s)), 0) + 1
    assert got == want


def test_variant_filters_meet_on_one_variant(spark):
    fv = spark.createDataFrame(
        [(1, 0, "color", "r", None), (1, 1, "size", "l", None), (2, 0, "color", "r", None), (2, 0, "size", "l", None)], "doc_id int, variant_pos int, name string, value_norm string, num_value double"
    )
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = P.apply_filters(docs, fv, [Filter("color", values=("r",), level="VARIANT"), Filter("size", values=("l",), level="VARIANT")])
    assert [r.doc_id for r in got.collect()] == [2]


# --- ingest


def test_attributes_to_fields(spark):
    kind = "doc_id int, data map<string,array<string>>, attributes array<struct<name:string,code:string,value:string>>"
    df = spark.createDataFrame([(1, {}, [("color", None, "red"), ("color", None, "black"), ("size", "L", "Large")])], kind)
    assert R.attributes_to_fields(df).first().data == {"color": ["red", "black"]}
    assert R.attributes_to_fields(df, include=["size"]).first().data == {"size": ["Large"]}
    assert R.attributes_to_fields(df, exclude=["color"]).first().data == {}


def test_path_ancestors(spark):
    assert one(spark, J.path_ancestors, ["a", "b/c"], "array<string>") == ["a", "a/b%2Fc"] and one(spark, J.path_ancestors, [], "array<string>") == []


def test_store_lifecycle(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/s")
    a = store.start("p", "de")
    store.add(a, spark.range(3).withColumnRenamed("id", "doc_id"))
    assert store.deploy(a) and store.live("p-de") == 1 and not store.deploy(a)
    b = store.start("p", "de")
    store.add(b, spark.range(0).withColumnRenamed("id", "doc_id"))
    assert not store.deploy(b) and store.cleanup(0) == ["p-de/v=2"] and store.read("p-de").count() == 3
    with pytest.raises(ValueError):
        store.start("P", "de")


def test_stream_gives_the_latest_and_repeats_safely(spark, tmp_path):
    t = updates.Table(spark, f"file://{tmp_path}/t")
    one_, two = spark.createDataFrame([(1, 7, "put", 1.0), (2, 8, "put", 2.0)], "event_id int, doc_id int, op string, value double"), spark.createDataFrame([(3, 7, "delete", 0.0), (0, 8, "put", 9.0)], "event_id int, doc_id int, op string, value double")
    for _ in range(2):
        t.merge(one_, 0)
        t.merge(two, 1)
    assert [(r.doc_id, r.value) for r in t.read().collect()] == [(8, 2.0)]


# --- search

TITLES = ["makita electric circular saw", "netherite saw blade", "makita diamond blade", "hard iron blade", "makita drill", "bosch sabre saw"]


def test_relaxation_keeps_the_best_combinations(spark):
    df = spark.createDataFrame([(i + 1, t.split()) for i, t in enumerate(TITLES)], "doc_id int, tokens array<string>")
    stages = [search.Stage("all", "all"), search.Stage("relaxed", "relaxed")]
    r = search.staged_search(df, F.col("tokens"), SearchRequest("makita saw blade"), stages)
    assert sorted(x.doc_id for x in r.hits.collect()) == [1, 2, 3] and r.meta["strategy"] == "relaxed"


def test_rules():
    r = rules.rewrite("surpresseur", rules.parse_rules("surpresseur => SYNONYM: pompe à immerger"))
    assert r.label() == '(surpresseur OR "pompe à immerger")'
    assert rules.rewrite("a", rules.parse_rules("a => DELETE")).terms == ["a"]


def test_both_spellings_score_alike(spark):
    df = spark.createDataFrame([(1, "fußballschuhe"), (2, "fussballschuhe")], "doc_id int, t string").withColumn("tokens", X.words(X.german_characters(F.col("t"))))
    scores = [r.score for r in M.bm25(df, F.col("tokens"), ["fussballschuhe"]).collect()]
    assert scores[0] == scores[1] > 0


def test_heroes_come_first_and_unknown_ids_are_left_out(spark):
    hits = spark.createDataFrame([("002",), ("003",), ("005",), ("006",)], "doc_id string")
    ids = spark.createDataFrame([(x, i) for i, x in enumerate(["005", "003", "00x", "006", "003"])], "doc_id string, pos int")
    got = K.arrange(hits, [ids]).orderBy("set_no", "pos").collect()
    assert [r.doc_id for r in got] == ["005", "003", "006", "002"]


@pytest.mark.parametrize("strategy, want", [("pickAlways", [1, 2]), ("pickIfSingleHit", [2]), ("pickIfDrilledDown", [2]), ("pickIfBestScored", [1, 2])])
def test_variant_picking(spark, strategy, want):
    v = spark.createDataFrame([(1, 0, 2.0, 2), (1, 1, 1.0, 2), (2, 0, 1.0, 3)], "doc_id int, variant_pos int, score double, n_variants int")
    assert sorted(r.doc_id for r in K.pick_variant(v, strategy).collect()) == want


def test_registry():
    r = extensions.Registry(disabled=("b",), preferred={"x": "a"})
    r.add("facet", "x", lambda: 1, "a")
    r.add("facet", "x", lambda: 2, "c")
    r.add("facet", "y", lambda: 3, "b")
    assert r.get("facet", "x")() == 1 and r.get("facet", "y") is None and r.names("facet") == ["x"]


def test_the_library_does_not_need_its_corpus_part():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "stockweave"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert ".llm" not in file.read_text() and "import llm" not in file.read_text(), file


# --- query strings, product sets, patches, conditions


def _titles(spark):
    rows = [(1, "red bolt", "b1"), (2, "red widget", "b2"), (3, "old gear", "b1"), (4, "new bolt gear", "b2"), (5, "red old bolt", "b3")]
    return spark.createDataFrame(rows, "doc_id long, title string, brand string").withColumn("tokens", F.split("title", " "))


@pytest.mark.parametrize(
    "text, want",
    [
        ("red bolt", {1, 2, 4, 5}), ("red AND bolt", {1, 5}), ("+red -bolt", {2}), ("red NOT old", {1, 2}), ('"red bolt"', {1}), ('"red bolt"~1', {1, 5}),
        ("brand:b1", {1, 3}), ("+brand:b2 +(gear OR widget)", {2, 4}), ("wid*", {2}), ("bolr~", {1, 4, 5}), ("nofield:red", set()), ("", set()), ("((", set()), ("-red", {3, 4}),
        ("red^2 AND brand:b3", {5}), ("a\\:b", set()), ("b-1", set()),
    ],
)
def test_query_strings(spark, text, want):
    from stockweave.plans import querystring

    df = _titles(spark)
    got = querystring.search(df, text, {"title": F.col("tokens"), "brand": F.array("brand")})
    assert {r.doc_id for r in got.collect()} == want


def test_query_string_scores_weigh_fields_and_boosts(spark):
    from stockweave.plans import querystring

    got = querystring.search(_titles(spark), "red^2 b1 (old gear)^3", {"title": F.col("tokens"), "brand": F.array("brand")}, {"brand": 0.5})
    assert {r.doc_id: r.score for r in got.collect()} == {1: 2.5, 2: 2.0, 3: 6.5, 4: 3.0, 5: 5.0}


def test_product_sets_leave_out_unknown_and_used_ids(spark):
    from stockweave.plans import prodsets

    df = _titles(spark)
    sets = [prodsets.ProductSet("static", ids=(5, 99, 1, 5)), prodsets.ProductSet("dynamic", query="red", limit=5), prodsets.ProductSet("querystring", query="gear", limit=1), prodsets.ProductSet("none")]
    got = [[r.doc_id for r in f.orderBy("pos").collect()] for f in prodsets.resolve(sets, df, F.col("tokens"), {"title": F.col("tokens")})]
    assert got == [[5, 1], [2], [3], []]


def test_rescore_windows(spark):
    hits = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 5.0), (4, 1.0), (5, None)], "doc_id long, score double")
    again = lambda t: t.withColumn("score", F.lit(100.0))
    for window, want in ((0, set()), (2, {1, 2}), (3, {1, 2, 3}), (5, {1, 2, 3, 4, 5}), (9, {1, 2, 3, 4, 5})):
        got = K.rescore(hits, window, again).collect()
        assert len(got) == 5 and {r.doc_id for r in got if r.tier == 0} == want == {r.doc_id for r in got if r.score == 100.0}


def test_positions_number_all_rows(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "doc_id long, v long").repartition(5)
    got = {r.v: r.pos for r in K.positions(df, [F.col("v").desc()]).collect()}
    assert got == {v: 101 - v for v in range(101)}
    assert K.positions(df.limit(0), [F.col("v")]).count() == 0


def test_positions_of_many_wide_rows(spark):
    """Adaptive execution joins partitions by size; numbers must not depend on that."""
    n, before = 1_200_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.range(0, n, 1, 6).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), F.repeat(F.md5(F.col("id").cast("string")), 12).alias("wide"))
        got = K.positions(df, [F.col("v").desc(), F.col("doc_id")])
        total = got.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.countDistinct("doc_id")).first()
        assert tuple(total) == (n, n, 1, n, n)
        assert [(r.pos, r.doc_id) for r in got.filter("pos <= 3").orderBy("pos").collect()] == [(i + 1, r.doc_id) for i, r in enumerate(df.orderBy(F.desc("v"), "doc_id").limit(3).collect())]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "condition, selected, custom, want",
    [("brand=a,b", {"brand": ("a",)}, {}, False), ("brand=a,b", {"brand": ("b", "A")}, {}, True), ("brand=*&size=1", {"brand": ("x",)}, {}, False), ("brand=x", {"brand": ("y",)}, {"brand": "x"}, False), ("brand=x", {}, {"brand": "X"}, True)],
)
def test_all_values_of_a_dependency_must_be_selected(condition, selected, custom, want):
    assert A.dependency_met(condition, selected, custom) is want


def test_store_keeps_the_version_before(spark, tmp_path):
    from stockweave.operators.store import Store

    store = Store(spark, f"file://{tmp_path}/store")
    for n in range(4):
        s = store.start("shop", "en")
        store.add(s, spark.createDataFrame([(n,)], "doc_id long"))
        before = store.read("shop-en") if n else None
        assert store.deploy(s)
        if before is not None:
            assert [r.doc_id for r in before.collect()] == [n - 1]  # a reader that began before goes on
    assert store.live("shop-en") == 4 and store.versions("shop-en") == [3, 4] and [r.doc_id for r in store.read("shop-en").collect()] == [3]
    with pytest.raises(LookupError):
        store.read("none-en")


def test_stream_table_compacts_and_goes_on_after_a_restart(spark, tmp_path):
    from stockweave.streaming.updates import Table

    root, state, seq = f"file://{tmp_path}/t", {}, 0
    for batch in range(9):
        rows = []
        for i in range(5):
            seq += 1
            op = "delete" if (seq * 7) % 4 == 0 else "put"
            rows.append((seq, (seq * 3) % 8, op, float(seq)))
            state[(seq * 3) % 8] = (op, float(seq))
        table = Table(spark, root, compact_every=3)  # a new one each time: all state is in the folder
        for _ in range(2 if batch == 4 else 1):  # a batch that is run again
            table.merge(spark.createDataFrame(rows, "event_id long, doc_id long, op string, value double"), batch)
    got = {r.doc_id: r.value for r in Table(spark, root).read().collect()}
    assert got == {k: v for k, (op, v) in state.items() if op != "delete"}
    assert Table(spark, root)._numbers("base") == [5, 8] and Table(spark, root)._numbers("batch") == [8]
    with pytest.raises(LookupError):
        Table(spark, f"{root}-none").read()


def test_patches_of_attributes_categories_and_variants(spark):
    from stockweave.operators import projections as J

    kind = f"doc_id long, data map<string,string>, attributes {J.F_ATTRIBUTES}, categories array<array<string>>, variants array<struct<data:map<string,string>,attributes:{J.F_ATTRIBUTES}>>"
    have = [(1, {"a": "1", "b": "2", "ab": "12", "color": "x"}, [("color", None, "red"), ("w", None, "1")], [["c"]], [({"id": "v1", "p": "1"}, [("s", None, "1")]), ({"p": "none"}, None)]), (2, {"a": "1", "ab": "kept"}, None, None, None)]
    new = [(1, {"a": "9"}, [("color", "k", "blue"), ("color", "k2", "sky")], None, [({"id": "v1", "q": "5"}, None), ({"id": "v2"}, None), ({"id": "v1", "q": "6"}, None), ({"q": "no id"}, None)]), (2, {}, None, [["new"]], [({"id": "n"}, None)]), (3, {"a": "?"}, None, None, None)]
    got = {r.doc_id: r for r in J.patch_documents(spark.createDataFrame(have, kind), spark.createDataFrame(new, kind), {"ab": ["a", "b"]}, "id").collect()}
    assert set(got) == {1, 2}
    assert got[1].data == {"a": "9", "b": "2"} and [tuple(a) for a in got[1].attributes] == [("w", None, "1"), ("color", "k", "blue"), ("color", "k2", "sky")] and got[1].categories == [["c"]]
    assert [v.data for v in got[1].variants] == [{"id": "v1", "p": "1", "q": "6"}, {"id": "v2"}]
    assert got[2].data == {"a": "1", "ab": "kept"} and got[2].categories == [["new"]] and [v.data for v in got[2].variants] == [{"id": "n"}]


def _rules(*lines):
    from stockweave.plans import rules

    return rules.parse_rules("\n".join(lines))


@pytest.mark.parametrize(
    "q, lines, label",
    [
        ("surpresseur", ["surpresseur => SYNONYM: (pompe à immerger)"], '(surpresseur OR "pompe à immerger")'),
        ("input more", ["input =>", "  SYNONYM: word1 word2"], '(input OR "word1 word2") more'),
        ("Kreslo", ["kreslo => SYNONYM(0.82): POLSTER"], "(kreslo OR polster^0.82)"),
        ("super performance", ["super performance =>", " SYNONYM(1.6): akku", " SYNONYM(1.3): speicher & balkon"], '(super performance) OR ((akku^1.6 OR "speicher & balkon"^1.3))'),
        ("a b c", ["a b => SYNONYM: x", "b c => SYNONYM: y"], "(a b c) OR (a y) OR (x c)"),
        ("a b c", ["b => DELETE"], "a c"),
        ("a b", ["a b => DELETE"], "a b"),
    ],
)
def test_synonym_graphs(q, lines, label):
    from stockweave.plans import graph

    assert graph.build(q, _rules(*lines)).label() == label


def test_documents_match_the_best_variant(spark):
    """Against all variants by hand: every way to read the query, each run by its best alternative."""
    import itertools

    from stockweave.plans import graph

    lines = ["a b => SYNONYM(1.6): x ; SYNONYM(1.3): y z", "b c => SYNONYM(0.7): w", "c => SYNONYM(0.5): d", "a b c => SYNONYM(3): e", "f => DELETE"]
    docs = [(i, " ".join(t)) for i, t in enumerate(itertools.chain.from_iterable(itertools.permutations("abcdwxyzef"[:9], n) for n in (1, 2, 3)))]
    df = spark.createDataFrame(docs, "doc_id long, title string").withColumn("tokens", F.split("title", " "))
    spans = {(0, 1): [("a", 1)], (1, 2): [("b", 1)], (2, 3): [("c", 1), ("d", 0.5)], (0, 2): [("x", 1.6), ("y z", 1.3)], (1, 3): [("w", 0.7)], (0, 3): [("e", 3)]}
    paths = [[(0, 1), (1, 2), (2, 3)], [(0, 2), (2, 3)], [(0, 1), (1, 3)], [(0, 3)]]
    for spec, need in (("100%", len), ("-1", lambda p: max(len(p) - 1, 1)), ("1", lambda p: 1)):
        want = {}
        for i, t in docs:
            run = {s: max((w for x, w in some if f" {x} " in f" {t} "), default=0) for s, some in spans.items()}
            scores = [sum(run[s] for s in p) for p in paths if sum(run[s] > 0 for s in p) >= need(p)]
            if scores:
                want[i] = max(scores)
        found = graph.search(df, {"title": F.col("tokens")}, graph.build("a b c f", _rules(*lines)), spec=spec)
        assert {r.doc_id: round(r.score, 9) for r in found.collect()} == {i: round(s, 9) for i, s in want.items()} and want


def test_rules_on_a_table_of_queries_equal_those_on_one(spark):
    from stockweave.plans import graph, rules

    parsed = _rules("red bolt => SYNONYM(1.6): gear", "bolt => SYNONYM: nut ; DELETE", "cheap red => DELETE", "x x => SYNONYM: y", "x => DELETE")
    queries = ["red bolt", "cheap red bolt", "bolt", "x x x", "", "x bolt", "new red thing bolt"]
    df = spark.createDataFrame([(q,) for q in queries], "query string").withColumn("terms", F.filter(F.split("query", " "), lambda t: t != ""))
    got = {}
    for r in graph.edges(df, parsed).collect():
        got.setdefault(r.query, set()).add((r.begin, r.end, r.text, r.weight))
    kept = {r.query: r.terms for r in graph.without_deleted(df, parsed).collect()}
    for q in queries:
        g = graph.build(q, {h: [x for x in some if x.kind != "DELETE"] for h, some in parsed.items()})
        assert got.get(q, set()) == {(*s, " ".join(a.words), a.weight) for s, some in g.spans.items() for a in some}
        assert kept[q] == rules.rewrite(q, {h: [x for x in some if x.kind == "DELETE"] for h, some in parsed.items()}).terms


def test_links_of_entries(spark):
    import urllib.parse

    from stockweave.plans import search

    values = ["a", "b,c", "ü&", "x y"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for base in ({"q": "x", "offset": "12"}, {"q": "x", "brand": "a,b%2Cc", "zoom": "1"}, {"brand": "a"}):
        link, on = search.entry_links(base, "brand", F.col("v"))
        for r in df.select("v", link.alias("link"), on.alias("on")).collect():
            have = [x for x in base.get("brand", "").split(",") if x]
            own = r.v.replace(",", "%2C")
            new = [x for x in have if x != own] if own in have else [*have, own]
            assert r.on == (own in have)
            assert dict(urllib.parse.parse_qsl(r.link)) == {k: v for k, v in base.items() if k not in ("offset", "brand")} | ({"brand": ",".join(new)} if new else {})


def test_a_stage_matches_synonyms(spark):
    from stockweave.plans import search
    from stockweave.plans.params import SearchRequest

    df = spark.createDataFrame([(1, "red gear"), (2, "crimson gear"), (3, "blue gear"), (4, "small cog wheel")], "doc_id long, title string").withColumn("tokens", F.split("title", " "))
    parsed = _rules("red => SYNONYM(0.5): crimson", "red gear => SYNONYM(0.9): cog wheel")
    r = search.staged_search(df, F.col("tokens"), SearchRequest("red gear"), [search.Stage("all", "all")], rules=parsed)
    assert {(x.doc_id, round(x.score, 6)) for x in r.hits.collect()} == {(1, 2.0), (2, 1.5), (4, 0.9)}


@pytest.mark.parametrize("edits, longest", [(1, 24), (2, 24), (2, 6), (1, 4), (3, 7)])
def test_near_words_equal_all_distances(spark, edits, longest):
    import random

    from stockweave.operators import fuzzy

    r = random.Random(edits * 100 + longest)
    word = lambda: "".join(r.choice("abcü") for _ in range(r.randint(1, 14)))
    words = sorted({word() for _ in range(300)} | {"a" * n for n in range(1, 12)} | {"x" * 40 + "y" * 40, "x" * 41 + "y" * 40})
    mutated = []
    for w in words[::2]:
        m = list(w)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(m) + 1)
            m[k : k + r.randint(0, 1)] = r.choice(["", "a", "z"])
        mutated.append("".join(m))
    asked = [(t, r.randint(0, edits)) for t in mutated + words[:40] + [None, "", "x" * 40 + "y" * 39, "x" * 39 + "y" * 40]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for t, k in asked:
        for w in words:
            if t and abs(len(t) - len(w)) <= k and (d := distance(t, w)) <= k:
                want.add((t, w, d))
    table = fuzzy.build(spark.createDataFrame([(w, 1) for w in words] + [(None, 1), ("", 1)], "word string, n long"), edits, longest)
    got = fuzzy.near(table, spark.createDataFrame(asked, "term string, edits int"))
    assert {(x.term, x.word, x.distance) for x in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("shard_rows", [1 << 20, 7])
def test_stored_postings_equal_brute_force(spark, shard_rows):
    import collections
    import math
    import random

    from stockweave.operators import postings

    r = random.Random(shard_rows)
    texts = [" ".join(r.choice(["the", "the", "the", "a", "b", "c", "d", *[f"w{i}" for i in range(30)]]) for _ in range(r.randint(0, 40))) for _ in range(120)] + [None]
    docs = [(i, t) for i, t in enumerate(texts)]
    words = {i: (t or "").split() for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.filter(F.split("text", " "), lambda t: t != "")).repartition(3)
    index = postings.build(df, F.col("tokens"), shard_rows=shard_rows)
    queries = [(1, "the a w3"), (2, "w1 w1 zzz"), (3, ""), (4, "d c b a the")]
    asked = spark.createDataFrame(queries, "q long, text string").withColumn("tokens", F.filter(F.split("text", " "), lambda t: t != ""))
    scored = postings.score(index, postings.terms_of(asked, F.col("tokens"), "q"))
    average, want = sum(map(len, words.values())) / len(words), {}
    df_of = collections.Counter(t for w in words.values() for t in set(w))
    for q, text in queries:
        for d, w in words.items():
            for t, weight in collections.Counter(text.split()).items():
                if t in w:
                    tf = w.count(t)
                    part = weight * math.log(1 + (len(words) - df_of[t] + 0.5) / (df_of[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
                    want[q, d] = want.get((q, d), 0) + part
    got = {(x.query, x.doc_id): x.score / postings.MICRO for x in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    best = {}
    for x in postings.top(scored, 3).collect():
        best.setdefault(x.query, []).append((x["rank"], x.doc_id))
    for q, found in best.items():
        own = sorted((d for k, d in got if k == q), key=lambda d: (-round(got[q, d] * postings.MICRO), d))
        assert [d for _, d in sorted(found)] == own[:3]
    lists = [(1, ["the", "a"]), (2, ["the", "the", "the"]), (3, ["w1"]), (4, ["nowhere", "a"])]
    times = {(x.query, x.doc_id): x.times for x in postings.phrases(index, spark.createDataFrame(lists, "query long, words array<string>")).collect()}
    assert times == {(q, d): n for q, p in lists for d, w in words.items() if (n := sum(w[i : i + len(p)] == p for i in range(len(w))))}
    assert postings.score(index, postings.terms_of(asked.limit(0), F.col("tokens"), "q")).count() == 0


def test_postings_stay_where_they_are(spark):
    """The plan reads no text and shuffles no posting before they are matched."""
    from stockweave.operators import postings

    df = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(50)], "doc_id long, tokens array<string>")
    index = postings.build(df, F.col("tokens"))
    asked = spark.createDataFrame([(1, "a"), (2, "b7")], "query long, term string").withColumn("weight", F.lit(1.0))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = postings.score(index, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = met.splitlines()
    scan = next(i for i, line in enumerate(lines) if "postings_" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[join:scan])


def test_phrases_are_looked_for_in_each_row(spark):
    """Rows of one id and length are texts of their own; only the rarest word's places are tried."""
    from stockweave.operators import postings

    docs = [(1, ["a", "b", "a", "b"]), (1, ["a", "b", "c", "a"]), (2, ["a", "b"]), (3, None), (4, ["b", "a"])]
    index = postings.build(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), F.col("tokens"))
    asked = spark.createDataFrame([(7, ["a", "b"]), (7, ["a"]), (8, ["b", "a"]), (9, ["a", "z"])], "query long, words array<string>")
    found = postings.phrases(index, asked)
    assert sorted((x.query, x.doc_id, x.times) for x in found.collect()) == [(7, 1, 1), (7, 1, 2), (7, 1, 2), (7, 1, 2), (7, 2, 1), (7, 2, 1), (7, 4, 1), (8, 1, 1), (8, 4, 1)]
    scores = {(x.query, x.doc_id): x.score for x in postings.score(index, postings.terms_of(asked.limit(1), F.col("words"), "query")).collect()}
    assert scores.keys() == {(7, 1), (7, 2), (7, 4)}


def test_scores_are_summed_where_the_postings_are(spark):
    """No pair of a query and a document is shuffled, and shards grow in number with the documents, not in size."""
    from stockweave.operators import postings

    df = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(50)], "doc_id long, tokens array<string>")
    index = postings.build(df, F.col("tokens"), shard_rows=5 * 256)
    assert len(index.postings.inputFiles()) > 4
    asked = spark.createDataFrame([(1, "a"), (2, "b7")], "query long, term string").withColumn("weight", F.lit(1.0))
    plan = postings.score(index, asked)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(plan) if "postings_" in line)
    assert not any("Exchange" in line for line in plan[:scan] if "BroadcastExchange" not in line)


def test_buckets_of_postings_are_alike(spark):
    """The largest of many buckets, which a task holds, is not far above the mean."""
    from stockweave.operators import postings

    df = spark.range(6400).select(F.col("id").alias("doc_id"), F.array(F.lit("a")).alias("tokens"))
    index = postings.build(df, F.col("tokens"), shard_rows=100 * 256)
    sizes = [x["count"] for x in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 64 and sum(sizes) == 6400 and max(sizes) < 150


@pytest.mark.parametrize("products", [100_000, 20])
def test_products_are_spread_before_their_values_are_counted(spark, sf, monkeypatch, products):
    """Tasks hold so many products, whatever the files; values aren't shuffled to be counted once."""
    from stockweave.plans import q_facets

    monkeypatch.setattr(q_facets, "PRODUCTS", products)
    values = q_facets._values(spark, sf)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert values.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // products))
    plan = q_facets._stats(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(name" in line and "doc_id" in line for line in plan.splitlines())


def test_exclusive_facets_on_variants_equal_brute_force(spark):
    import random

    from stockweave.operators import facets

    r = random.Random(8)
    products = {d: ({"brand": r.choice("abc"), "size": r.choice("12")}, [{"color": r.choice("rg"), "status": r.choice("OF")} for _ in range(r.choice([0, 1, 2, 4]))]) for d in range(80)}
    rows = [(d, None, n, v) for d, (m, _) in products.items() for n, v in m.items()]
    rows += [(d, i, n, v) for d, (_, some) in products.items() for i, x in enumerate(some) for n, v in x.items()]
    df = spark.createDataFrame(rows, "doc_id long, variant_pos int, name string, value string").repartition(3)
    wanted = {"brand": "ab", "color": "r", "status": "F"}

    def brute(master, variant):
        out = {}
        holds = lambda x, names: all(x[n] in wanted[n] for n in names)
        for m, some in products.values():
            for n, v in m.items():
                if holds(m, master - {n}) and (not variant or any(holds(x, variant) for x in some)):
                    out[n, v] = out.get((n, v), 0) + 1
            for n, v in {(n, x[n]) for x in some for n in x if holds(x, variant - {n}) and holds(m, master)}:
                out[n, v] = out.get((n, v), 0) + 1
        return out

    for master, variant in (({"brand"}, {"color", "status"}), (set(), {"color"}), ({"brand"}, set()), ({"brand"}, {"status"}), (set(), set())):
        at = lambda names: {n: F.col("value").isin(*wanted[n]) for n in names}
        got = facets.exclusive_facets_on_variants(df, at(master), at(variant)).collect()
        assert {(x.name, x.value): x.doc_count for x in got} == brute(master, variant)


def test_typed_values_too_large_to_be_cut(spark):
    """A double that no whole number of 38 digits holds is a value, and goes from a list of whole ones; it is no error."""
    from stockweave.sources import documents

    rows = [(0, '{"v": 1e300}'), (1, '{"v": [1, 1e300, -2.5, 1e20]}'), (2, '{"v": [3000000000, -1e300, 1e12]}'), (3, '{"v": [1e300, 7]}')]
    got = spark.createDataFrame(rows, "i int, text string").select("i", documents.typed_data(F.col("text"))["v"].alias("v")).select("i", "v.*").collect()
    assert {r.i: (r.kind, r.texts) for r in got} == {0: ("double", [["1.0E300"]]), 1: ("int[]", [["1", "-2"]]), 2: ("long[]", [["3000000000", "1000000000000"]]), 3: ("double[]", [["1.0E300"]])}


def test_typed_values_of_documents(spark):
    from stockweave.sources import documents

    cases = {
        '"string values test"': ("string", [["string values test"]]), "12.5": ("double", [["12.5"]]), "true": ("string", [["true"]]), "3000000000": ("long", [["3000000000"]]), "null": ("null", []),
        '["val1", "val2", "val3"]': ("string[]", [["val1", "val2", "val3"]]), '["1", "2", "34"]': ("string[]", [["1", "2", "34"]]), "[38, 39, 40, 42, 42]": ("int[]", [["38", "39", "40", "42", "42"]]),
        '["30%", 12]': ("string[]", [["30%", "12"]]), "[1.5, 2, 3.5]": ("double[]", [["1.5", "3.5"]]), "[1, 2.9, -2.9, 3000000000]": ("int[]", [["1", "2", "-2"]]), "[3000000000, 1, 2.5]": ("long[]", [["3000000000", "1", "2"]]),
        "[]": (None, []), "{}": (None, []), "[[[1]]]": (None, []), "[null]": (None, []), "[[1], [2, 3]]": ("int[][]", [["1"], ["2", "3"]]), '[null, "x"]': ("string[]", [["x"]]),
    }
    rows = [(i, '{"v": %s}' % k) for i, k in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", documents.typed_data(F.col("text"))["v"].alias("v")).select("i", "v.*").collect()
    assert {r.i: (r.kind, r.texts) for r in got} == dict(enumerate(cases.values()))
    path = lambda *p: [None if n is None else tuple(n) for n in p]
    objects = {
        '{"name": "color", "code": "ff0000", "value": "red"}': ("attribute", ("color", "ff0000", "red"), []),
        '{"name": "color", "value": 5}': ("attribute", ("color", None, None), []),
        '{"name": {"a": 1}, "value": "x"}': (None, None, []),
        '[{"id": "1", "name": "Men"}, {"name": "Shoes"}, {"x": 1}]': ("path", None, [path(("1", "Men"), (None, "Shoes"))]),
        '[[{"id": "100", "name": "Sale"}, {"id": "1", "name": "Men"}], [{"id": 2, "name": "Shoes"}], ["x"]]': ("path[]", None, [path(("100", "Sale"), ("1", "Men")), path(("2", "Shoes"))]),
    }
    rows = [(i, '{"v": %s}' % k) for i, k in enumerate(objects)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", documents.typed_data(F.col("text"))["v"].alias("v")).select("i", "v.*").collect()
    assert {r.i: (r.kind, None if r.attribute is None else tuple(r.attribute), [[tuple(c) for c in p] for p in r.paths]) for r in got} == dict(enumerate(objects.values()))
    plain = spark.createDataFrame([("{bad",), (None,), ('"x"',), ('{"k": "abc", "n": 7, "l": [1, 2], "o": {"a": 1}}',)], "text string")
    assert [r[0] for r in plain.select(documents.typed_data(F.col("text")).isNull()).collect()] == [True, True, True, False]
    last = plain.filter("text LIKE '%abc%'").select(*[documents.values_of(F.col("text"), f"$.{k}").alias(k) for k in "knlo"]).first()
    assert (last.k, last.n, last.l, last.o) == (["abc"], ["7"], ["1", "2"], [])


def test_concurrent_sessions_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from stockweave.operators.store import Store

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: Store(spark, f"file://{tmp_path}/t").start("parts", "en"), range(24)))
    assert sorted(n for _, n in got) == list(range(1, 25)) and {name for name, _ in got} == {"parts-en"}
    assert Store(spark, f"file://{tmp_path}/t").versions("parts-en") == list(range(1, 25))


def test_snapshots_are_swapped_under_a_running_reader(spark, tmp_path):
    import time

    from stockweave.operators import suggest_index as index
    from stockweave.operators.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    records = lambda *texts: spark.createDataFrame([(t, None, 1) for t in texts], "text string, secondary string, weight long")
    reader = index.Poller(store, "words-en")
    assert reader.current() is None
    assert index.publish(store, "words", "en", records("red ring", "rod"))
    asked = spark.createDataFrame([("r",)], "query string")
    first = index.lookup(reader.current(), asked)
    assert reader.current() is reader.frame and [x.text for x in first.orderBy("rank").collect()] == ["red ring", "rod"]
    time.sleep(0.01)
    assert index.publish(store, "words", "en", records("rope"))
    assert [x.text for x in first.orderBy("rank").collect()] == ["red ring", "rod"]  # begun before, still readable
    assert [x.text for x in index.lookup(reader.current(), asked).collect()] == ["rope"]
    assert not index.publish(store, "words", "en", records()) and [x.text for x in index.lookup(reader.current(), asked).collect()] == ["rope"]


@pytest.mark.parametrize("keep, limit", [(100, 10), (3, 3)])
def test_suggestions_by_prefix_equal_brute_force(spark, keep, limit):
    import random

    from stockweave.operators import suggest_index as index

    r = random.Random(keep)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 9)))
    rows = [(" ".join(word() for _ in range(r.randint(1, 3))), r.choice([None, word(), f"{word()} {word()}"]), r.choice([None, 1, 2, 3])) for _ in range(150)]
    rows += [(None, "x", 1), ("", "x", 1), ("  ", "a", 5), (rows[0][0], "aa", 9), ("Ab  Ba", "É b", 2)]
    norm = lambda t: " ".join((t or "").lower().split())
    best = {}
    for t, s, w in rows:
        if t and t.strip():
            best[t] = max(best.get(t, (-1, "")), (w or 0, s or ""))
    asked = sorted({x[:n] for t in best for x in norm(t).split() + [norm(t)] for n in (1, 2, 3, 6, 7, 9)} | {"zzz", "", " ", "AB", "b a"})
    want = set()
    for q in asked:
        p, hits = norm(q), []
        for t, (w, s) in best.items():
            own = lambda x: bool(p) and (norm(x).startswith(p) or f" {p}" in norm(x))  # noqa: E731, B023
            if own(t) or own(s):
                hits.append((1 if own(t) else 2, -w, t.encode()))
        want |= {(q, t.decode(), s, -w, k + 1) for k, (s, w, t) in enumerate(sorted(hits)[:limit])}
    stored = index.index(spark.createDataFrame(rows, "text string, secondary string, weight long"), keep)
    got = index.lookup(stored, spark.createDataFrame([(q,) for q in asked], "query string"), limit).collect()
    assert {(x.query, x.text, x.stage, x.weight, x["rank"]) for x in got} == want and len(want) > 100


@pytest.mark.parametrize(
    "shares, available, limit, want",
    [
        ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 99, "b": 99, "c": 99}, 10, {"a": 5, "b": 3, "c": 2}),
        ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 99, "b": 99, "c": 2}, 20, {"a": 11, "b": 7, "c": 2}),
        ({"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 10, {"a": 1, "b": 2}),
        ({"a": 0.9, "b": 0.1}, {"b": 50}, 10, {"a": 0, "b": 10}),
        ({"a": 1.0, "b": 0.0}, {"a": 3, "b": 9}, 5, {"a": 3, "b": 0}),
        ({"a": 0.34, "b": 0.33, "c": 0.33}, {"a": 9, "b": 9, "c": 9}, 4, {"a": 2, "b": 1, "c": 1}),
        ({}, {}, 5, {}),
    ],
)
def test_unused_shares_go_to_other_groups(shares, available, limit, want):
    from stockweave.operators import suggest

    assert suggest.allot(shares, available, limit) == want


def test_group_limit_with_prefetch_and_groups_without_share(spark):
    from stockweave.operators import suggest

    rows = [(f"t{i:02d}", 100 - i, "ab"[i % 2] if i < 16 else "z") for i in range(20)]
    df = spark.createDataFrame(rows, "text string, weight long, kind string")
    kinds = lambda x: sorted(r.kind for r in x.collect())
    assert kinds(suggest.group_limit(df, "kind", {"a": 0.5, "b": 0.25}, 8)) == ["a"] * 4 + ["b"] * 2 + ["z"] * 2
    assert kinds(suggest.group_limit(df, "kind", {"a": 0.5, "b": 0.25}, 8, prefetch=2)) == ["a"] * 5 + ["b"] * 3
    assert suggest.group_limit(df.limit(0), "kind", {"a": 1.0}, 8).count() == 0

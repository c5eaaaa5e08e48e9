"""The life of a search request, with the plug-ins that its steps call.

A ``Service`` is made of one configuration.  A request's text is preprocessed and
analyzed, product sets are resolved, stages search until one is sufficient, hits are
boosted, rescored or sorted, and a page of them is dealt out to slices.  Each step is a
plan on the documents; what comes to the driver are counts, and the last row of each
rescorer's window."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import ranking as K
from ..operators.filters import apply_filters
from ..sources import scratch
from . import prodsets
from .extensions import LOG, Registry
from .params import SearchRequest
from .rules import Analyzed, merge_filters
from .search import STRATEGIES, Stage, staged_search


@dataclass
class Response:
    """``page``: the documents' columns with ``score``, ``at`` (the place among all hits),
    ``slice_no``, ``slice`` and the slice's ``match_count``."""

    page: DataFrame
    meta: dict


def whitespace(q: str) -> Analyzed:
    return Analyzed(q.lower().split())


@dataclass
class Service:
    """Plug-ins and stages of one configuration.

    A configuration names ``query_preprocessors``, a ``query_analyzer`` and ``rescorers``;
    ``plugins`` has their settings.  A stage whose strategy isn't built in is made by the
    query factory of that name, and left out if there is none."""

    stages: list[Stage]
    registry: Registry
    preprocessors: dict[str, Callable] = field(default_factory=dict)
    analyzer: Callable[[str], Analyzed] = whitespace
    rescorers: dict[str, Callable] = field(default_factory=dict)
    rules: dict | None = None

    @classmethod
    def configure(cls, tenant: str, config: dict, registry: Registry) -> Service:
        for provider in registry.configured("config", registry.names("config")).values():
            config = provider(tenant, config)
        settings = config.get("plugins", {})
        own = [s.strategy for s in config["stages"] if s.strategy not in STRATEGIES]
        factories = registry.configured("query_factory", list(dict.fromkeys(own)), settings)
        stages = [dataclasses.replace(s, factory=factories.get(s.strategy)) for s in config["stages"] if s.strategy in STRATEGIES or s.strategy in factories]
        wanted = config.get("query_analyzer")
        analyzers = registry.configured("query_analyzer", [wanted], settings) if wanted else {}
        return cls(
            stages, registry, registry.configured("query_preprocessor", config.get("query_preprocessors", []), settings),
            analyzers.get(wanted, whitespace), registry.configured("rescorer", config.get("rescorers", []), settings), config.get("rules"),
        )

    def analyze(self, q: str, meta: dict) -> Analyzed:
        for preprocessor in self.preprocessors.values():
            q = preprocessor(q, meta)
        meta["preprocessed"] = q
        found = self.analyzer(q)
        meta["analyzed"] = found.label()
        return found

    def rescorers_for(self, request: SearchRequest) -> list[K.Rescorer]:
        """None for sorted requests.  A provider that fails is left out until the next configuration."""
        out = []
        for name, provider in list(self.rescorers.items() if not request.sort else ()):
            try:
                made = provider(request.q, request.custom)
            except Exception:
                LOG.exception("rescorer %s fails and is removed", name)
                del self.rescorers[name]
                continue
            if made is not None:
                out.append(made)
        return out

    def find(self, docs: DataFrame, values: DataFrame, tokens: Column, request: SearchRequest, sets: list[prodsets.ProductSet] = (), columns: dict[str, Column] | None = None) -> Response:
        """``docs`` have ``doc_id`` and a sort's ``<field>_lo`` and ``<field>_hi``; ``values`` are their facet values.

        Product sets are in front of the hits, their filtered documents too.  Without the
        main result the text isn't searched, and there are no hits but the sets'."""
        meta: dict = {}
        chosen = [scratch.keep(s, "set") for s in prodsets.resolve(list(sets), docs, tokens, columns or {}, self.registry)]
        sizes = [s.count() for s in chosen]
        ids = reduce(DataFrame.unionByName, chosen).select("doc_id") if chosen else None
        analyzed = self.analyze(request.q, meta) if request.include_main and request.q else Analyzed([])
        if not request.include_main:
            meta["include_main"] = False
        filters = merge_filters(list(request.filters) + analyzed.filters)
        docs = apply_filters(docs, values, filters)
        for term in analyzed.raw:
            docs = docs.filter(M.has(tokens, term.lower()))
        heroes = docs.join(ids, "doc_id", "left_semi").withColumn("score", F.lit(0.0)) if ids is not None else None

        def with_heroes(found: DataFrame) -> DataFrame:
            return found.unionByName(heroes.join(found.select("doc_id"), "doc_id", "left_anti"))

        if not request.include_main:
            hits = docs.filter(F.lit(False)).withColumn("score", F.lit(0.0)) if heroes is None else heroes
        else:
            asked = dataclasses.replace(request, q=" ".join(analyzed.terms) or (request.q if not request.q.strip() else ""), filters=filters)
            result = staged_search(docs, tokens, asked, self.stages, heroes=sum(sizes), hero_ids=ids, rules=self.rules, always=with_heroes if heroes is not None else None)
            meta |= result.meta
            score = F.col("score").cast("double")
            for term, w in analyzed.boosts:
                score = K.up_down(score, M.has(tokens, term), up=w) if w > 0 else K.up_down(score, M.has(tokens, term), down=-w)
            hits = result.hits.withColumn("score", score)
        hits = K.hero_boost(hits, chosen) if chosen else hits.withColumn("set_no", F.lit(0)).withColumn("pos", F.lit(None).cast("long"))
        hits = K.rescored(hits, self.rescorers_for(request), len(chosen), sum(sizes))
        return Response(self._slices(hits, request, list(sets), sizes), meta)

    def _slices(self, hits: DataFrame, request: SearchRequest, sets: list[prodsets.ProductSet], sizes: list[int]) -> DataFrame:
        """A page of the hits.  Sorted ones, and those of sets that aren't separate, are in the main slice."""
        own = [] if request.sort else [i for i, s in enumerate(sets) if s.separate]
        no, label, matches = F.lit(len(sets)), F.lit("main"), F.lit(None).cast("long")
        for i in own:
            mine = F.col("set_no") == i
            no, label = F.when(mine, F.lit(i)).otherwise(no), F.when(mine, F.lit(sets[i].name)).otherwise(label)
            matches = F.when(mine, F.lit(sizes[i]).cast("long")).otherwise(matches)
        if request.include_main:
            main = hits.filter(~F.col("set_no").isin(own)) if own else hits
            matches = F.coalesce(matches, F.lit(main.count()))
        order = K.sort_columns(request.sort) if request.sort else [F.col("score").desc(), F.col("doc_id").asc()]
        page = K.page(hits, order, request.limit, request.offset)
        # No more rows than the request's page.
        at = (F.row_number().over(Window.orderBy(*order)) - 1 + request.offset).alias("at")
        page = page.select("*", at, no.alias("slice_no"), label.alias("slice"), matches.alias("match_count"))
        return page if request.include_main else page.filter(F.col("slice_no") < len(sets))


def index(docs: DataFrame, project: Callable[[DataFrame], DataFrame], store, session: tuple[str, int], plugins: dict[str, Callable], post: dict[str, Callable], minimum: int = 1) -> bool:
    """Documents through preprocessors, projection and postprocessors into a version of a store.

    The version goes live if it has enough documents; else, and if anything fails, it is
    cancelled.  All plug-ins with ``finish`` hear which, also if one of them fails at that."""
    done = False
    try:
        for p in plugins.values():
            docs = p(docs)
        records = project(docs)
        for p in post.values():
            records = p(records)
        store.add(session, records)
        done = store.deploy(session, minimum)
    finally:
        done = done or store.live(session[0]) == session[1]
        if not done:
            store.cancel(session)
        for name, p in {**plugins, **post}.items():
            try:
                getattr(p, "finish", lambda success: None)(done)
            except Exception:
                LOG.exception("%s can't finish", name)
    return done

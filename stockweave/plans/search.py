"""The staged search: strategies in order until a result is sufficient."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from . import graph
from .params import Filter, QueryCondition, SearchRequest, parse_trace


@dataclass(frozen=True)
class Stage:
    name: str
    strategy: str  # all, any, phrase, fuzzy, trigram, relaxed, predicted, match_all, none
    condition: QueryCondition = QueryCondition()
    min_should_match: str = "100%"
    accept_no_result: bool = False
    fallback: Stage | None = None  # where a prediction or relaxation has nothing; and the boost of its matches
    factory: Callable[[DataFrame, Column, list[str]], DataFrame | None] | None = None  # a plug-in's: hits with ``score``, or none to skip the stage


@dataclass
class SearchResult:
    hits: DataFrame
    meta: dict = field(default_factory=dict)


#: What ``Stage.strategy`` may be without a plug-in.
STRATEGIES = ("all", "any", "phrase", "fuzzy", "trigram", "relaxed", "predicted", "match_all", "none")


def run_stage(docs: DataFrame, tokens: Column, terms: list[str], stage: Stage, rules: graph.Rules | None = None) -> DataFrame | None:
    """Matches with ``score``.  Where rules have synonyms for the terms, ``all`` and ``any``
    match and score the variants of the query."""
    if stage.factory is not None and terms:
        return stage.factory(docs, tokens, terms)
    if stage.strategy == "none":
        return docs.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    if stage.strategy == "match_all" or not terms:
        return docs.withColumn("score", F.lit(1.0))
    if stage.strategy == "phrase":
        return docs.filter(M.phrase(tokens, terms)).withColumn("score", F.lit(float(len(terms))))
    if stage.strategy == "fuzzy":
        hit = sum((M.fuzzy(tokens, t).cast("int") for t in terms), F.lit(0))
        return docs.withColumn("score", hit.cast("double")).filter(F.col("score") >= M.min_should_match(stage.min_should_match, len(terms)))
    if stage.strategy == "trigram":
        return docs.withColumn("score", M.trigram_share(F.array_join(tokens, " "), " ".join(terms))).filter("score >= 0.7")
    if stage.strategy in ("relaxed", "predicted"):
        if stage.strategy == "relaxed":
            found = M.relaxed(docs, tokens, terms).withColumn("score", F.col("matched").cast("double")).drop("matched")
        else:
            found = M.predicted(docs, tokens, terms)
        if stage.fallback is None:
            return found
        if not found.take(1):
            return run_stage(docs, tokens, terms, stage.fallback, rules)
        return _boosted_by_unmatched(found, tokens, terms)
    spec = stage.min_should_match if stage.strategy == "all" else "1"
    variants = graph.build(" ".join(terms), rules or {})
    if any(len(some) != 1 for some in variants.spans.values()) or len(variants.spans) > len(terms):
        return graph.search(docs, {"text": tokens}, variants, spec=spec)
    matched = M.match(M.bm25(docs, tokens, terms), tokens, terms, spec)
    return matched.drop("matched")


def _boosted_by_unmatched(found: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """Terms that a hit lacks add to its score if one of its words is near to them."""
    near = [F.when(~M.has(tokens, t) & M.fuzzy(tokens, t), F.lit(0.5)).otherwise(0.0) for t in terms]
    return found.withColumn("score", sum(near, F.col("score")))


def sufficient(found: DataFrame, request: SearchRequest, heroes: int = 0, hero_ids: DataFrame | None = None) -> bool:
    """More hits than heroes; with filters, which may have left heroes out, hits beyond
    the page or one that is no hero.  Without a main result anything will do.  Counts no
    further than it has to."""
    if not request.include_main:
        return True
    if not request.filters:
        return found.limit(heroes + 1).count() > heroes
    page = request.offset + request.limit
    total = found.limit(max(heroes, page) + 1).count()
    if total > heroes or total > page:
        return True
    if not total or hero_ids is None:
        return False
    return bool(found.join(hero_ids.select("doc_id"), "doc_id", "left_anti").take(1))


def staged_search(
    docs: DataFrame, tokens: Column, request: SearchRequest, stages: list[Stage], dictionary: DataFrame | None = None, heroes: int = 0, only: int | None = None, hero_ids: DataFrame | None = None, trace: str | None = None, rules: graph.Rules | None = None, always: Callable[[DataFrame], DataFrame] | None = None
) -> SearchResult:
    """Stage by stage; one small count decides.  Before the next stage, an
    insufficient one is tried once with corrected spelling.  Blank queries without
    filters give an empty result with an error.  ``docs`` are those that meet the
    request's filters, heroes among them; ``rules`` give synonyms and deletions, ``always``
    adds what is found at any stage.  A stage whose plug-in gives nothing is skipped."""
    flags = parse_trace(trace)
    terms = request.q.lower().split()
    if not terms and not request.filters and request.q:
        return SearchResult(docs.filter(F.lit(False)).withColumn("score", F.lit(0.0)), {"error": "blank query"})
    chosen = [s for s in stages if s.condition.holds(request.q)]
    if only is not None:
        chosen = chosen[only : only + 1]
    if not terms:  # nothing to search for: all that the filters leave
        chosen = [Stage("_match_all", "match_all", accept_no_result=True)]
    meta: dict = {"query": request.q}
    found = docs.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    for n, stage in enumerate(chosen):
        tries = [terms]
        while tries:
            mine = tries.pop()
            own = run_stage(docs, tokens, mine, stage, rules)
            if own is None:
                continue
            found = own if always is None else always(own)
            meta |= {"stage": n, "strategy": stage.name}
            if "request" in flags:
                meta["trace_request"] = {"q": request.q, "filters": len(request.filters), "terms": mine}
            if "esquery" in flags:
                meta.setdefault("trace_query", []).append(found._jdf.queryExecution().optimizedPlan().toString())
            if sufficient(found, request, heroes, hero_ids) or stage.accept_no_result:
                return SearchResult(found, meta)
            if dictionary is not None and mine is terms and terms:
                better = {r.term: r.correction for r in M.spell_corrections(dictionary, terms).collect()}  # a query's few terms
                if better:
                    meta["corrections"] = better
                    tries.append([better.get(t, t) for t in terms])
    return SearchResult(found, meta)


def links(base: dict[str, str], f: Filter | None = None, remove: str | None = None, **other: str) -> str:
    """A query string with a filter added or removed, a sort or a page set; paging starts over on a new filter."""
    params = {k: v for k, v in base.items() if k != remove}
    if f is not None:
        key = f.field + (".id" if f.kind == "id" else "")
        have = [v for v in params.get(key, "").split(",") if v]
        new = [v.replace(",", "%2C") for v in f.values]
        params[key] = ",".join(dict.fromkeys(have + new))
    if f is not None or remove is not None:
        params.pop("offset", None)
    params |= other
    return urllib.parse.urlencode(sorted(params.items()))


def entry_links(base: dict[str, str], name: str, value: Column) -> tuple[Column, Column]:
    """The query string of each entry of a facet, and whether its filter is on.

    An entry adds its value to the field's filter, or takes it off; paging starts over."""
    have = [v for v in base.get(name, "").split(",") if v]
    rest = {k: v for k, v in base.items() if k not in (name, "offset")}
    plain = F.replace(value, F.lit(","), F.lit("%2C"))
    on = plain.isin(*have) if have else F.lit(False)
    left = F.filter(F.array(*map(F.lit, have)).cast("array<string>"), lambda v: v != plain)
    values = F.array_join(F.when(on, left).otherwise(F.concat(F.array(*map(F.lit, have)).cast("array<string>"), F.array(plain))), ",")
    own = F.when(values != "", F.concat(F.lit(f"{urllib.parse.quote_plus(name)}="), F.url_encode(values)))
    parts = {k: F.lit(urllib.parse.urlencode([(k, v)])) for k, v in rest.items()} | {name: own}
    return F.concat_ws("&", *[parts[k] for k in sorted(parts)]), on


def merge_config(defaults: dict, own: dict, use_default: dict[str, bool] | None = None) -> dict:
    """A tenant's sections over the defaults'; a section may shut the defaults out.
    Lists of named entries merge by name, own entries first."""
    out = {}
    for section in {**defaults, **own}:
        base = defaults.get(section) if (use_default or {}).get(section, True) else None
        mine = own.get(section)
        if isinstance(base, dict) and isinstance(mine, dict):
            out[section] = {**base, **mine}
        elif isinstance(base, list) and isinstance(mine, list):
            names = {x.get("name") for x in mine}
            out[section] = mine + [x for x in base if x.get("name") not in names]
        else:
            out[section] = mine if mine is not None else base
    return out

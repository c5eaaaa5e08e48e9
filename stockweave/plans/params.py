"""Request parameters: filters, sorting, paging, conditions; read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FieldIndex


@dataclass(frozen=True)
class Filter:
    """One field's filter: values, or a range with inclusive ends (open if null)."""

    field: str
    kind: str = "term"  # term, id, number, path
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    negate: bool = False
    level: str = "MASTER"
    induced: bool = False

    def merge(self, other: Filter) -> Filter:
        """A second filter on the field: union of values, wider range; an
        including filter replaces an excluding one."""
        if self.negate != other.negate:
            return self if not self.negate else other
        if self.kind == "number":
            low = None if self.low is None or other.low is None else min(self.low, other.low)
            high = None if self.high is None or other.high is None else max(self.high, other.high)
            return replace(self, low=low, high=high)
        return replace(self, values=tuple(dict.fromkeys(self.values + other.values)))


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    value: str | None = None  # sort by a facet value of this kind
    value_id: bool = False
    missing: str = "0"


@dataclass
class SearchRequest:
    q: str = ""
    filters: list[Filter] = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    limit: int = 12
    offset: int = 0
    custom: dict[str, str] = field(default_factory=dict)
    include_main: bool = True  # arranged requests may ask for their product sets only


def split_values(text: str) -> list[str]:
    return [v.replace("%2C", ",").replace("%2c", ",") for v in text.split(",") if v]


def parse_number(text: str) -> tuple[float | None, float | None] | None:
    """``a,b``, ``a-b``, ``a-``, ``-b``, or one exact value."""
    text = text.strip()
    one = r"\d+(?:\.\d+)?|\.\d+"
    m = re.fullmatch(rf"(-?(?:{one}))?\s*,\s*(-?(?:{one}))?", text) or re.fullmatch(rf"({one})?\s*-\s*({one})?", text)
    if m and (m[1] or m[2]):
        ends = [float(x) if x else None for x in m.groups()]
        return tuple(sorted(ends)) if None not in ends else tuple(ends)
    return (float(text), float(text)) if re.fullmatch(rf"-?(?:{one})", text) else None


def parse_filters(params: dict[str, str], fields: FieldIndex) -> list[Filter]:
    """Filters on fields with FACET or FILTER usage; what can't be read is ignored."""
    out: dict[str, Filter] = {}
    for key, raw in params.items():
        name, by_id = (key[:-3], True) if key.endswith(".id") else (key, False)
        found = [f for f in fields.match(name) if {"FACET", "FILTER"} & set(f.usage)]
        if not found or not raw:
            continue
        f, negate = found[0], raw.startswith("!")
        text = raw[1:] if negate else raw
        if f.type == "NUMBER" and not by_id:
            ends = parse_number(text)
            if ends is None:
                continue
            new = Filter(f.name, "number", (), ends[0], ends[1], negate, f.level)
        elif f.type == "CATEGORY":
            new = Filter(f.name, "path_id" if by_id else "path", tuple(v.lower() for v in split_values(text)), negate=negate, level=f.level)
        else:
            values = split_values(text)
            new = Filter(f.name, "id" if by_id else "term", tuple(values if by_id else (v.lower() for v in values)), negate=negate, level=f.level)
        at = f"{f.name}/{new.kind}"
        out[at] = out[at].merge(new) if at in out else new
    return list(out.values())


def parse_sort(text: str, fields: FieldIndex) -> list[Sort]:
    """``a,-b``, ``field.value``, ``field.id.X``; only fields that may be sorted, or facets by value."""
    out = []
    for part in filter(None, (text or "").split(",")):
        down, name = part.startswith("-"), part.lstrip("-")
        direct = [f for f in fields.match(name) if "SORT" in f.usage]
        if direct:
            out.append(Sort(direct[0].name, down))
            continue
        base, _, value = name.partition(".")
        by_id = value.startswith("id.")
        if value and any("FACET" in f.usage for f in fields.match(base)):
            out.append(Sort(base, down, value[3:] if by_id else value, by_id))
    return out


def page(limit: int | None, offset: int | None, most: int = 10_000) -> tuple[int, int]:
    limit = min(max(0, 12 if limit is None else limit), most)
    return limit, min(max(0, offset or 0), most - limit)


def next_offset(limit: int, offset: int, total: int) -> int | None:
    return offset + limit if offset + limit < total else None


def parse_request(params: dict[str, str], fields: FieldIndex) -> SearchRequest:
    known = {"q", "sort", "limit", "offset"}
    filters = parse_filters({k: v for k, v in params.items() if k not in known}, fields)
    limit, offset = page(int(params["limit"]) if "limit" in params else None, int(params.get("offset", 0)))
    custom = {k: v for k, v in params.items() if k not in known and not fields.match(k.removesuffix(".id"))}
    return SearchRequest(params.get("q", ""), filters, parse_sort(params.get("sort", ""), fields), limit, offset, custom)


@dataclass(frozen=True)
class QueryCondition:
    """When a strategy is used: a pattern, a range of term counts, a longest length."""

    pattern: str | None = None
    min_terms: int = 1
    max_terms: int = 2**31
    max_length: int = 2**31

    def holds(self, q: str) -> bool:
        n = len(q.split())
        return (self.pattern is None or re.search(self.pattern, q) is not None) and self.min_terms <= n <= self.max_terms and len(q) <= self.max_length

    def column(self, q: Column) -> Column:
        """The same for a column of queries."""
        n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
        return (F.lit(True) if self.pattern is None else q.rlike(self.pattern)) & n.between(self.min_terms, self.max_terms) & (F.length(q) <= self.max_length)


def first_strategy(q: Column, strategies: list[tuple[str, QueryCondition]]) -> Column:
    """The name of the first strategy whose condition a query meets."""
    return F.coalesce(*[F.when(c.column(q), F.lit(n)) for n, c in strategies])


TRACE_FLAGS = ("request", "esquery")


def parse_trace(text: str | None) -> frozenset[str]:
    """Known trace flags of a list, without case; others are ignored."""
    return frozenset(TRACE_FLAGS) & {x.strip().lower() for x in (text or "").split(",")}

"""Query strings: terms, phrases, fields, groups and operators, as Column expressions.

``red -bolt (ring OR gear)^2 brand:"brand#11" wid* bolr~``: a clause is optional
unless ``+`` or AND makes it needed; ``-`` or NOT excludes.  A clause that is of no
field is looked up in all of them, weighted."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import matching as M

_TOKEN = re.compile(r'\s*(?:(?P<op>AND|OR|NOT|&&|\|\|)(?=[\s()]|$)|(?P<sign>[+\-!])(?=\S)|(?P<open>\()|(?P<close>\))|(?P<field>[\w.]+):(?=\S)|"(?P<phrase>(?:[^"\\]|\\.)*)"(?:~(?P<slop>\d+))?|(?P<word>(?:[^\s()"\\^]|\\.)+)|\^(?P<boost>\d+(?:\.\d+)?))')


@dataclass(frozen=True)
class Clause:
    kind: str  # term, prefix, fuzzy, phrase, group
    words: tuple[str, ...] = ()
    parts: tuple[tuple[str, Clause], ...] = ()  # of a group: "must", "should" or "not", and the clause
    field: str | None = None
    boost: float = 1.0
    slop: int = 0


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text).lower()


def parse(text: str) -> Clause:
    """A group of clauses; what doesn't close is closed at the end, what can't be read is left out."""
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end() if m and m.end() > at else at + 1
        if m and m.lastgroup:
            found.append(m)
    clause, _ = _group(found, 0)
    return clause


def _group(found: list, i: int) -> tuple[Clause, int]:
    parts: list[tuple[str, Clause]] = []
    role, field, joined = "should", None, False
    while i < len(found):
        m = found[i]
        i += 1
        if m["close"]:
            break
        if m["boost"]:
            if parts:
                parts[-1] = (parts[-1][0], replace(parts[-1][1], boost=float(m["boost"])))
            continue
        if m["op"]:
            if m["op"] in ("AND", "&&"):
                joined = True
                if parts and parts[-1][0] == "should":
                    parts[-1] = ("must", parts[-1][1])
            elif m["op"] == "NOT":
                role = "not"
            continue
        if m["sign"]:
            role = "must" if m["sign"] == "+" else "not"
            continue
        if m["field"]:
            field = m["field"]
            continue
        if m["open"]:
            clause, i = _group(found, i)
            clause = replace(clause, field=field)
        elif m["phrase"] is not None:
            clause = Clause("phrase", tuple(_plain(m["phrase"]).split()), field=field, slop=int(m["slop"] or 0))
        else:
            word = m["word"]
            kind = "fuzzy" if word.endswith("~") else "prefix" if word.endswith("*") else "term"
            clause = Clause(kind, (_plain(word if kind == "term" else word[:-1]),), field=field)
        if clause.words not in ((), ("",)) or clause.parts:
            parts.append(("must" if joined and role == "should" else role, clause))
        role, field, joined = "should", None, False
    return Clause("group", parts=tuple(parts)), i


def _one(clause: Clause, tokens: Column) -> Column:
    if clause.kind == "phrase":
        return M.phrase(tokens, list(clause.words), clause.slop)
    if clause.kind == "prefix":
        return F.exists(tokens, lambda t: t.startswith(clause.words[0]))
    return M.fuzzy(tokens, clause.words[0]) if clause.kind == "fuzzy" else M.has(tokens, clause.words[0])


def evaluate(clause: Clause, fields: dict[str, Column], weights: dict[str, float] | None = None, field: str | None = None) -> tuple[Column, Column]:
    """Whether a document matches, and its score: of each clause that matches, the
    weight of its best field times the clause's boost.  An unknown field matches nothing."""
    field = clause.field or field
    if clause.kind != "group":
        some = {n: c for n, c in fields.items() if field in (None, n)}
        hits = [(F.coalesce(_one(clause, c), F.lit(False)), (weights or {}).get(n, 1.0) * clause.boost) for n, c in some.items()]
        scores = [F.when(h, F.lit(float(w))).otherwise(0.0) for h, w in hits]
        return reduce(Column.__or__, [h for h, _ in hits], F.lit(False)), F.greatest(*scores, F.lit(0.0), F.lit(0.0))
    got = [(role, *evaluate(c, fields, weights, field)) for role, c in clause.parts]
    needed = [m for role, m, _ in got if role == "must"] + [~m for role, m, _ in got if role == "not"]
    optional = [m for role, m, _ in got if role == "should"]
    if optional and not any(role == "must" for role, *_ in got):
        needed.append(reduce(Column.__or__, optional))
    score = reduce(Column.__add__, [s for role, _, s in got if role != "not"], F.lit(0.0))
    return reduce(Column.__and__, needed, F.lit(bool(needed))), score * F.lit(clause.boost)


def search(docs, text: str, fields: dict[str, Column], weights: dict[str, float] | None = None):
    """The documents that match, with ``score``."""
    hit, score = evaluate(parse(text), fields, weights)
    return docs.withColumn("score", score).filter(hit)

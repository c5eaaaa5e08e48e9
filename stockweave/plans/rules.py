"""Query rules: synonyms, deletions, filters and boosts, by a small rule language.

    sofa =>
      SYNONYM(0.8): couch
      FILTER: category:living
      UP(2): leather

Rules match runs of terms.  A synonym of a run makes an alternative of it; a
deletion takes the run away unless nothing would be left."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .params import Filter


@dataclass
class Instruction:
    kind: str
    weight: float
    text: str


@dataclass
class Analyzed:
    """Terms with alternatives; filters and boosts that rules add."""

    terms: list[str]
    alternatives: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    filters: list[Filter] = field(default_factory=list)
    boosts: list[tuple[str, float]] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)

    def label(self) -> str:
        def one(t: str) -> str:
            alts = [f'"{a}"' if " " in a else a for a, _ in self.alternatives.get(t, [])]
            ws = [w for _, w in self.alternatives.get(t, [])]
            return f"({' OR '.join([t, *[a if w == 1 else f'{a}^{w:g}' for a, w in zip(alts, ws)]])})" if alts else t

        return " ".join(one(t) for t in self.terms)


def parse_rules(text: str) -> dict[tuple[str, ...], list[Instruction]]:
    rules: dict[tuple[str, ...], list[Instruction]] = {}
    current: tuple[str, ...] | None = None
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if "=>" in line:
            head, _, line = line.partition("=>")
            current = tuple(head.lower().replace('"', " ").split())
            rules.setdefault(current, [])
        for part in filter(None, (p.strip() for p in line.split(";"))):
            m = re.fullmatch(r"(SYNONYM|UP|DOWN|FILTER|DELETE)(?:\(([\d.]+)\))?\s*(?::\s*(.*))?", part)
            if m and current is not None:
                rules[current].append(Instruction(m[1], float(m[2] or 1), (m[3] or "").strip()))
    return rules


def filter_of(text: str) -> Filter | str:
    """``field:value``, ``-field:value`` or ``field.id:value``; else a raw term."""
    m = re.fullmatch(r"\*?\s*(-)?([\w.]+?)(\.id)?:(.+)", text)
    if not m:
        return text
    value = m[4].strip().strip("\"'")
    return Filter(m[2], "id" if m[3] else "term", (value if m[3] else value.lower(),), negate=bool(m[1]), induced=True)


def merge_filters(filters: list[Filter]) -> list[Filter]:
    out: dict[str, Filter] = {}
    for f in filters:
        key = f"{f.field}/{f.kind}"
        out[key] = out[key].merge(f) if key in out else f
    return list(out.values())


def rewrite(q: str, rules: dict[tuple[str, ...], list[Instruction]]) -> Analyzed:
    terms = q.lower().split()
    out, gone, filters = Analyzed(list(terms)), set(), []
    for head, instructions in rules.items():
        for i in range(len(terms) - len(head) + 1):
            if tuple(terms[i : i + len(head)]) != head:
                continue
            for x in instructions:
                if x.kind == "SYNONYM":
                    out.alternatives.setdefault(" ".join(head), []).append((x.text.lower(), x.weight))
                elif x.kind == "DELETE":
                    gone |= set(range(i, i + len(head)))
                elif x.kind == "FILTER":
                    f = filter_of(x.text)
                    out.raw.append(f) if isinstance(f, str) else filters.append(f)
                else:
                    out.boosts.append((x.text.lower(), x.weight if x.kind == "UP" else -x.weight))
    kept = [t for i, t in enumerate(terms) if i not in gone]
    out.terms = kept or terms
    out.filters = merge_filters(filters)
    multi = [h for h in out.alternatives if " " in h and h in " ".join(out.terms)]
    for h in multi:
        n = len(h.split())
        at = next(i for i in range(len(out.terms)) if " ".join(out.terms[i : i + n]) == h)
        out.terms[at : at + n] = [h]
    return out

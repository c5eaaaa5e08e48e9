"""Field configuration: what each input key becomes, and on which level."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

USAGES = ("SEARCH", "RESULT", "SORT", "FACET", "FILTER", "SCORE")
TYPES = ("STRING", "NUMBER", "CATEGORY", "ID", "RAW")
LEVELS = ("MASTER", "VARIANT", "BOTH")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "STRING"
    level: str = "MASTER"
    source_names: tuple[str, ...] = ()
    usage: tuple[str, ...] = ()
    value_delimiter: str | None = None
    search_prefix: str | None = None
    dynamic: bool = False

    def __post_init__(self) -> None:
        if self.type == "RAW" and "FACET" in self.usage:
            raise ValueError(f"{self.name}: raw values can't be facets")

    @property
    def on_master(self) -> bool:
        return self.level in ("MASTER", "BOTH")

    @property
    def on_variant(self) -> bool:
        return self.level in ("VARIANT", "BOTH")


class FieldIndex:
    """Finds fields by name or source name; dynamic fields only if nothing matches.

    One input key may feed several fields.  Of the dynamic fields the first counts
    whose name, a pattern, is found in the key and whose type fits the value."""

    def __init__(self, fields: list[Field]):
        self.fixed = [f for f in fields if not f.dynamic]
        self.dynamic = [f for f in fields if f.dynamic]

    def match(self, key: str, value: object = None) -> list[Field]:
        found = [f for f in self.fixed if key == f.name or key in f.source_names]
        if found:
            return found
        for f in self.dynamic:
            if re.search(f.name, key) and self._fits(f, value):
                return [replace(f, name=key, dynamic=False)]
        return []

    @staticmethod
    def _fits(f: Field, value: object) -> bool:
        if f.type == "NUMBER":
            return isinstance(value, (int, float)) or bool(re.fullmatch(r"-?\d+(\.\d+)?(E-\d+)?|-?\.\d+", str(value)))
        if f.type == "CATEGORY":
            return isinstance(value, (list, tuple))
        return True

    def primary_category(self) -> Field | None:
        some = [f for f in self.fixed if f.type == "CATEGORY"]
        if len(some) == 1:
            return some[0]
        named = [f for f in some if f.name in ("categories", "category")]
        plain = [f for f in some if not f.source_names]
        return next(iter(named or plain), None)

    def merged(self, other: FieldIndex) -> FieldIndex:
        """Fields of both; rejects what can't be sorted or faceted together."""
        mine = {f.name: f for f in self.fixed}
        for f in other.fixed:
            g = mine.get(f.name)
            if g is None:
                mine[f.name] = f
                continue
            if ("SORT" in f.usage) != ("SORT" in g.usage):
                raise ValueError(f"{f.name}: sorted in one index only")
            if f.type != g.type and {"FACET", "SCORE"} & set(f.usage) & set(g.usage):
                raise ValueError(f"{f.name}: two types")
            level = f.level if f.level == g.level else "BOTH"
            mine[f.name] = replace(g, level=level, usage=tuple(dict.fromkeys(g.usage + f.usage)))
        return FieldIndex([*mine.values(), *self.dynamic])

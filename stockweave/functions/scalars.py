"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, and what they fold to.
UNDECOMPOSED = {"ð": "d", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ŀ": "l", "ł": "l", "ŉ": "n", "ŋ": "n", "ø": "o", "ſ": "s", "ŧ": "t"}
#: Capitals that folding leaves alone.
KEPT_CAPITALS = "ÄÖÜ"
NUMBER = r"^(-?\d+(\.\d+)?(E-\d+)?|-?\.\d+)$"


def _folding() -> tuple[str, str]:
    """Latin-1 and Latin Extended-A letters with marks fold to small ASCII letters."""
    pairs = {}
    for code in range(0xC0, 0x180):
        c = chr(code)
        base = UNDECOMPOSED.get(c.lower()) or unicodedata.normalize("NFD", c)[0].lower()
        if c not in KEPT_CAPITALS and base.isascii() and base.isalpha():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def asciify(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def parse_number(c: Column) -> Column:
    """A number, or null for text that isn't one (``1e3`` isn't)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_list(c: Column) -> Column:
    return F.filter(F.transform(c, parse_number), lambda x: x.isNotNull())


def string_list(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("string"))


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def half_down(c: Column, digits: int = 2) -> Column:
    """Ties round down; ``round`` is half up."""
    return F.ceil(c * 10**digits - F.lit(0.5)) / 10**digits


def half_up(c: Column, digits: int = 2) -> Column:
    return F.floor(c * 10**digits + F.lit(0.5)) / 10**digits


def round_mode(c: Column, mode: str) -> Column:
    return {"floor": F.floor, "ceil": F.ceil, "round": F.round}[mode](c)


def is_empty(c: Column, kind: str = "string") -> Column:
    return c.isNull() | ((F.size(c) == 0) if kind == "array" else (F.length(c) == 0))


def collect_values(a: Column, b: Column) -> Column:
    """Distinct values of two lists, the first's order first."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))


def min_max(c: Column) -> Column:
    return F.array_distinct(F.array(F.array_min(c), F.array_max(c)))


def as_float(c: Column) -> Column:
    return c.cast("float")


def same_type(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def map_overlay(base: Column, over: Column) -> Column:
    """Keys of both, the second's value first."""
    return F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))


def map_underlay(base: Column, under: Column) -> Column:
    """Keys of both, the first's value first."""
    return F.map_zip_with(base, under, lambda _, a, b: F.coalesce(a, b))


def escape_path(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("%2F"))


def escape_delimiter(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("%2C"))


def unescape_delimiter(c: Column) -> Column:
    return F.replace(c, F.lit("%2C"), F.lit(","))


def index_name(c: Column) -> Column:
    """Lower case; characters that a name may not have become dashes, outer dashes go."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_.]+", "-"), r"^-+|-+$", "")


def age_seconds(then: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then)


def json_value(c: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def format_number(c: Column, digits: int) -> Column:
    """Up to so many decimals, closing zeros dropped."""
    text = F.format_string(f"%.{digits}f", c.cast("double"))
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text

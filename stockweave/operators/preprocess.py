"""Document preprocessors: row transforms on documents.

A document is ``doc_id``, ``data`` (map of name to a list of strings) and
``attributes`` (list of name, code, value).  Each transform is Column
expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import asciify

DATA = "map<string,array<string>>"


def _change(df: DataFrame, names: list[str], change) -> DataFrame:
    return df.withColumn("data", F.transform_values("data", lambda k, v: F.when(k.isin(*names), change(v)).otherwise(v)))


def _put(df: DataFrame, name: Column | str, value: Column) -> DataFrame:
    key = name if isinstance(name, Column) else F.lit(name)
    new = F.when(value.isNotNull(), F.create_map(key, value)).otherwise(F.create_map().cast(DATA))
    return df.withColumn("data", F.map_zip_with("data", new, lambda _, a, b: F.coalesce(b, a)))


def ascii_fold(df: DataFrame, names: list[str]) -> DataFrame:
    return _change(df, names, lambda v: F.transform(v, asciify))


def attributes_to_fields(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Attributes become data: those included; else those not excluded without a code; else those without a code."""
    if include:
        chosen = lambda a: a["name"].isin(*include)
    elif exclude:
        chosen = lambda a: ~a["name"].isin(*exclude) & a["code"].isNull()
    else:
        chosen = lambda a: a["code"].isNull()
    moved = F.filter("attributes", chosen)
    names = F.array_distinct(F.transform(moved, lambda a: a["name"]))
    grouped = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_distinct(F.transform(F.filter(moved, lambda a: a["name"] == n), lambda a: a["value"])).alias("value"))))
    out = df.withColumn("data", F.map_zip_with("data", grouped, lambda _, a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))))
    return out.withColumn("attributes", F.filter("attributes", lambda a: ~chosen(a)))


def category_levels(df: DataFrame, name: str, depth: int) -> DataFrame:
    """``<name>_lvl_<i>`` and ``<name>_leaf``: the distinct names of each depth, space-joined."""
    paths = F.transform(F.element_at("data", name), lambda p: F.split(p, "/"))
    for i in range(depth):
        level = F.array_distinct(F.filter(F.transform(paths, lambda p: F.get(p, F.lit(i))), lambda x: x.isNotNull()))
        df = _put(df, f"{name}_lvl_{i}", F.when(F.size(level) > 0, F.array(F.array_join(level, " "))))
    leaf = F.array_distinct(F.transform(paths, lambda p: F.element_at(p, -1)))
    return _put(df, f"{name}_leaf", F.when(F.size(leaf) > 0, F.array(F.array_join(leaf, " "))))


def flag_field(df: DataFrame, source: str, target: str, rules: list[tuple[str, str]], no_match: str | None = None) -> DataFrame:
    """The first rule with a pattern that is found gives the value; ``##`` separates patterns."""
    value = F.element_at("data", source)
    found = lambda patterns: reduce(Column.__or__, [F.exists(value, lambda v: v.rlike(p)) for p in patterns.split("##")])
    flag = reduce(lambda c, r: c.when(found(r[0]), F.lit(r[1])), rules[1:], F.when(found(rules[0][0]), F.lit(rules[0][1])))
    flag = flag.otherwise(F.lit(no_match)) if no_match is not None else flag
    return _put(df, target, F.when(flag.isNotNull(), F.array(flag)))


def remove_values(df: DataFrame, name: str, pattern: str, split: str = r"\s+", join: str = " ") -> DataFrame:
    """Tokens that match fully go; a list has distinct values afterwards."""
    def clean(v: Column) -> Column:
        return F.array_join(F.filter(F.split(v, split), lambda t: ~t.rlike(f"^(?:{pattern})$")), join)

    return _change(df, [name], lambda v: F.array_distinct(F.filter(F.transform(v, clean), lambda x: x != "")))


def replace_pattern(df: DataFrame, name: str, pattern: str, by: str) -> DataFrame:
    """Empty results go; a list has distinct values afterwards."""
    return _change(df, [name], lambda v: F.array_distinct(F.filter(F.transform(v, lambda x: F.regexp_replace(x, pattern, by)), lambda x: x != "")))


def skip_documents(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Documents go if a value matches fully."""
    return df.filter(~F.coalesce(F.exists(F.element_at("data", name), lambda v: v.rlike(f"^(?:{pattern})$")), F.lit(False)))


def split_value(df: DataFrame, name: str, pattern: str, targets: list[str] | None = None, wildcard: str | None = None, parts: int = 8, keep: bool = True) -> DataFrame:
    """Parts of a value to fields: by position if their number fits, or ``<wildcard>_<i>``."""
    pieces = F.split(F.get(F.element_at("data", name), F.lit(0)), pattern)
    names = targets or [f"{wildcard}_{i}" for i in range(parts)]
    for i, t in enumerate(names):
        fits = (F.size(pieces) == len(targets)) if targets else (F.size(pieces) > i)
        df = _put(df, t, F.when(fits, F.array(F.get(pieces, F.lit(i)))))
    return df if keep else df.withColumn("data", F.map_filter("data", lambda k, _: k != name))


def split_words(df: DataFrame, names: list[str], target: str, dictionary: list[str]) -> DataFrame:
    """Words of some fields into one, compounds split where both parts are in a dictionary.

    The dictionary is a bounded list of a request's configuration."""
    words = F.array_distinct(F.flatten(F.array(*[F.flatten(F.transform(F.coalesce(F.element_at("data", n), F.array().cast("array<string>")), lambda v: F.split(F.lower(v), r"[^\p{L}\p{N}]+"))) for n in names])))
    known = F.array(*[F.lit(w) for w in dictionary])

    def parts(w: Column) -> Column:
        cuts = F.filter(known, lambda h: w.startswith(h) & F.array_contains(known, F.substring(w, F.length(h) + 1, F.length(w))))
        head = F.get(cuts, F.lit(0))
        return F.when(F.size(cuts) > 0, F.array(w, head, F.substring(w, F.length(head) + 1, F.length(w)))).otherwise(F.array(w))

    return _put(df, target, F.array(F.array_join(F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w != ""), parts))), " ")))


def split_delimited(df: DataFrame, name: str, delimiter: str) -> DataFrame:
    """Values of a field with a value delimiter become several values."""
    return _change(df, [name], lambda v: F.array_distinct(F.filter(F.transform(F.flatten(F.transform(v, lambda x: F.split(x, delimiter))), F.trim), lambda x: x != "")))

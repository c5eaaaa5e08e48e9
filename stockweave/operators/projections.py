"""Usage projections: documents to search, result, sort, filter, facet and score data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_path, parse_number


def search_content(values: Column, prefix: str = "") -> Column:
    text = F.array_join(values, " ")
    return F.concat(F.lit(prefix + " "), text) if prefix else text


def with_variant_content(master: DataFrame, variants: DataFrame, name: str) -> DataFrame:
    """Variants' distinct search values are copied to the product, sorted."""
    own = variants.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(name)), " ").alias(f"{name}_content"))
    return master.join(own, "doc_id", "left")


def path_ancestors(path: Column) -> Column:
    """``A``, ``A/B``, ``A/B/C`` of a list of names; slashes in names are encoded."""
    n = F.size(path)
    safe = F.transform(path, escape_path)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(safe, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def sort_ends(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Least and greatest value of a product over all levels."""
    return rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def number_entries(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """Numeric facet entries; what isn't a number is left out."""
    return rows.select(key, F.lit(name).alias("name"), parse_number(value).alias("num_value")).filter("num_value IS NOT NULL")


def rejects(rows: DataFrame, value: Column) -> DataFrame:
    """Rows whose required number can't be read: they are dismissed."""
    return rows.filter(value.isNotNull() & parse_number(value).isNull())


def score_max(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(value).alias("score"))


def patch(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """Field-level merge of ``(doc_id, data)`` maps: an update's fields win, other
    fields stay; ids that are new are appended.  Of several updates of an id the
    last by ``seq`` counts, if there is such a column."""
    if "seq" in updates.columns:
        updates = updates.groupBy("doc_id").agg(F.max_by("data", "seq").alias("data"))
    u = updates.select(F.col("doc_id").alias("__id"), F.col("data").alias("__data"))
    merged = F.when(F.col("data").isNull(), F.col("__data")).when(F.col("__data").isNull(), F.col("data")).otherwise(F.map_zip_with("data", "__data", lambda _, a, b: F.coalesce(b, a)))
    return docs.join(u, docs["doc_id"] == u["__id"], "full").select(F.coalesce("doc_id", "__id").alias("doc_id"), merged.alias("data"))


def filter_entries(rows: DataFrame, key: str, fields: list) -> DataFrame:
    """Distinct values of fields with FILTER usage; one that is a facet, too, is
    filtered by its facet entries and has none here.  ``key, name, values``."""
    own = [f.name for f in fields if "FILTER" in f.usage and "FACET" not in f.usage and f.name in rows.columns]
    if not own:
        return rows.select(key, F.lit("").alias("name"), F.array().cast("array<string>").alias("values")).filter(F.lit(False))
    listed = rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in own])).alias("e"))
    return listed.filter("e.v IS NOT NULL").groupBy(key, F.col("e.name").alias("name")).agg(F.sort_array(F.collect_set("e.v")).alias("values"))


#: Facet data by field type.
FACET_DATA = {"NUMBER": "number_facets", "CATEGORY": "path_facets"}


def required_fields(names: list[str], fields, has_variants: bool = False) -> set[str]:
    """Which parts of an indexed document a patch of these fields needs."""
    hit = [f for n in names for f in fields.match(n) if "FACET" in f.usage]
    return {FACET_DATA.get(f.type, "term_facets") for f in hit} | ({"variants"} if has_variants else set())


def _without_combined(data: Column, combined: dict[str, list[str]]) -> Column:
    """Fields made of others go if all of these are there; they are made again."""
    for name, sources in combined.items():
        if len(sources) > 1:
            whole = F.lit(True)
            for s in sources:
                whole = whole & F.map_contains_key(data, s)
            gone = F.when(whole, F.lit(name))
            data = _without_key(data, gone)
    return data


def _without_key(data: Column, name: Column) -> Column:
    return F.map_filter(data, lambda k, _: F.coalesce(k != name, F.lit(True)))


def _patched(have: Column, new: Column, combined: dict[str, list[str]]) -> tuple[Column, Column]:
    """Data and attributes of a document or variant with its patch."""
    mine, theirs = have["attributes"], new["attributes"]
    names = F.transform(F.coalesce(theirs, F.array().cast(F_ATTRIBUTES)), lambda a: a["name"])
    data = F.map_filter(_without_combined(have["data"], combined), lambda k, _: ~F.array_contains(names, k))
    data = F.map_zip_with(data, F.coalesce(new["data"], F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(b, a))
    kept = F.filter(F.coalesce(mine, F.array().cast(F_ATTRIBUTES)), lambda a: ~F.array_contains(names, a["name"]))
    return data, F.when(theirs.isNull(), mine).otherwise(F.concat(kept, theirs))


F_ATTRIBUTES = "array<struct<name:string,code:string,value:string>>"


def patch_variants(have: Column, new: Column, variant_id: str | None, combined: dict[str, list[str]]) -> Column:
    """Variants with an id that is patched, too, are merged, others stay, new ones are
    appended; without an id field the patch's replace all.  Ones without id go."""
    if variant_id is None:
        return F.when(F.coalesce(F.size(new), F.lit(0)) <= 0, have).otherwise(new)
    key = lambda v: v["data"][variant_id]
    last = F.filter(new, lambda v, i: key(v).isNotNull() & ~F.exists(F.slice(new, i + 2, F.size(new)), lambda w: F.coalesce(key(w) == key(v), F.lit(False))))

    def merged(v: Column) -> Column:
        match = F.get(F.filter(last, lambda w: key(w) == key(v)), F.lit(0))
        data, attributes = _patched(v, match, combined)
        return F.when(match.isNull(), v).otherwise(F.struct(data.alias("data"), attributes.alias("attributes")))

    old = F.transform(F.filter(have, lambda v: key(v).isNotNull()), merged)
    added = F.filter(last, lambda w: ~F.exists(have, lambda v: F.coalesce(key(v) == key(w), F.lit(False))))
    return F.when(F.coalesce(F.size(new), F.lit(0)) <= 0, have).when(have.isNull(), new).otherwise(F.concat(old, added))


def patch_documents(docs: DataFrame, updates: DataFrame, combined: dict[str, list[str]] | None = None, variant_id: str | None = None) -> DataFrame:
    """Patches of whole documents ``(doc_id, data map, attributes, categories,
    variants)``: attributes replace those of the same name, and data of that name;
    categories are replaced as a whole; data fields win; variants merge by id.
    Only known ids are patched; the code of the others is NOT_FOUND."""
    u = updates.select(F.col("doc_id").alias("__id"), F.struct("data", "attributes", "categories", "variants").alias("__new"))
    j = docs.join(u, docs["doc_id"] == u["__id"], "left")
    have, new = F.struct("data", "attributes"), F.col("__new")
    data, attributes = _patched(have, new, combined or {})
    changed = F.col("__id").isNotNull()
    return j.select(
        "doc_id", F.when(changed, data).otherwise(F.col("data")).alias("data"), F.when(changed, attributes).otherwise(F.col("attributes")).alias("attributes"),
        F.when(changed, F.coalesce(new["categories"], F.col("categories"))).otherwise(F.col("categories")).alias("categories"),
        F.when(changed, patch_variants(F.col("variants"), new["variants"], variant_id, combined or {})).otherwise(F.col("variants")).alias("variants"),
    )

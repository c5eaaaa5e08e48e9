"""Readers of documents: JSON, JSON lines, CSV; and back from indexed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = "struct<name:string,code:string,value:string>"
DOCUMENT = f"id string, data map<string,string>, attributes array<{ATTRIBUTE}>, categories array<array<struct<id:string,name:string>>>, variants array<struct<id:string,data:map<string,string>,attributes:array<{ATTRIBUTE}>>>"


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents by a fixed schema; unknown properties are ignored."""
    return spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)


def read_csv(spark: SparkSession, path: str, id_column: str, separator: str = ",", quote: str = '"') -> DataFrame:
    """Each row a document; its columns but the id are data."""
    rows = spark.read.option("header", True).option("sep", separator).option("quote", quote).csv(path)
    names = [c for c in rows.columns if c != id_column]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in names])
    return rows.select(F.col(id_column).alias("id"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("data"))


def values_of(json_text: Column, path: str = "$") -> Column:
    """A value of a JSON text as strings: a scalar as one, a list of one type as many; objects and deeper lists as none."""
    v = F.try_variant_get(F.try_parse_json(json_text), path, "variant")
    many = F.try_variant_get(v, "$", "array<string>")
    one = F.try_variant_get(v, "$", "string")
    scalar = ~F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(many, F.when(scalar & one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


_CATEGORY = "array<struct<id:string,name:string>>"
#: A typed value: ``texts`` and ``paths`` hold one list for each inner list of the value.
VALUE = f"struct<kind:string,texts:array<array<string>>,paths:array<{_CATEGORY}>,attribute:{ATTRIBUTE}>"
_INT = 2**31


def _member(v: Column, name: str) -> Column:
    """A member of an object as a VARIANT.  Through a map: a path that isn't there costs an exception each time."""
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


def _has_scalar(v: Column, name: str) -> Column:
    """Whether an object has a member of that name that is a scalar other than null."""
    return F.coalesce(~F.schema_of_variant(_member(v, name)).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(False))


def _is_double(schema: Column) -> Column:
    return schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT")


def _kinds(elements: Column) -> Column:
    """What each element is: long (int too), string (booleans are text), double, path for an object with a scalar name; null for the rest."""

    def of(schema: Column, i: Column) -> Column:
        named = F.when(schema.startswith("OBJECT"), F.when(_has_scalar(F.get(elements, i), "name"), "path"))
        return F.when(schema == "BIGINT", "long").when(schema.isin("STRING", "BOOLEAN"), "string").when(_is_double(schema), "double").otherwise(named)

    return F.transform(F.transform(elements, F.schema_of_variant), of)


def _cut(text: Column) -> Column:
    """A double's text without its fraction."""
    number = text.cast("double").try_cast("decimal(38,6)")
    return F.when(text.startswith("-"), F.ceil(number)).otherwise(F.floor(number)).cast("decimal(38,0)").cast("string")


def _typed_lists(lists: Column) -> Column:
    """``kind, texts, path`` of each list: its first element that is a value or a category fixes the type; what doesn't fit it goes.

    Texts are taken from a list at once: one by one each would cost as much as the whole list."""
    no_texts, no_path = F.array().cast("array<string>"), F.array().cast(_CATEGORY)

    def known(x: Column) -> Column:
        return F.struct(x["v"].alias("v"), x["elements"].alias("elements"), _kinds(x["elements"]).alias("kinds"))

    def begun(x: Column) -> Column:
        first = F.get(F.filter(x["kinds"], lambda k: k.isNotNull()), F.lit(0))
        return F.struct(x["elements"].alias("elements"), x["kinds"].alias("kinds"), F.try_variant_get(x["v"], "$", "array<string>").alias("texts"), first.alias("kind"))

    def whole(x: Column) -> Column:
        first = F.get(F.filter(x["texts"], lambda _, i: F.get(x["kinds"], i) == "long"), F.lit(0))
        texts = F.transform(x["texts"], lambda t, i: F.when(F.get(x["kinds"], i) == "long", t).when(F.get(x["kinds"], i) == "double", _cut(t)))
        is_long = x["kind"] == "long"
        kind = F.when(is_long & first.try_cast("int").isNotNull(), "int").otherwise(x["kind"])
        return F.struct(x["elements"].alias("elements"), x["kinds"].alias("kinds"), F.when(is_long, texts).otherwise(x["texts"]).alias("texts"), kind.alias("kind"))

    def done(x: Column) -> Column:
        kind, of = x["kind"], lambda i: F.get(x["kinds"], i)
        texts = (
            F.when(kind == "int", F.filter(x["texts"], lambda t: t.try_cast("int").isNotNull())).when(kind == "long", F.filter(x["texts"], lambda t: t.isNotNull()))
            .when(kind == "string", F.filter(x["texts"], lambda _, i: of(i).isin("string", "long", "double"))).when(kind == "double", F.filter(x["texts"], lambda _, i: of(i) == "double")).otherwise(no_texts)
        )
        named = F.filter(x["elements"], lambda _, i: of(i) == "path")
        path = F.transform(named, lambda e: F.struct(F.try_variant_get(_member(e, "id"), "$", "string").alias("id"), F.try_variant_get(_member(e, "name"), "$", "string").alias("name")))
        return F.struct(kind.alias("kind"), texts.alias("texts"), F.when(kind == "path", path).otherwise(no_path).alias("path"))

    steps = F.transform(lists, lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$", "array<variant>").alias("elements")))
    for step in (known, begun, whole, done):
        steps = F.transform(steps, step)
    return steps


def typed_values(v: Column) -> Column:
    """A JSON value, a VARIANT, as a :data:`VALUE`, in a list of one.

    Scalars are int, long, double or string; ``null`` is a value.  In a list the first
    element fixes the type: later numbers are cut to whole ones after an int or long, whole ones
    go after a double, all scalars are text after a string; what doesn't fit goes.
    Objects with a name are categories and a list of them a path.  Lists may be nested
    once, and the first inner list fixes the type of the others.  An object with a
    scalar name and value is an attribute, whose parts count if they are strings.
    Anything else, deeper or empty lists too, has the kind null: no value.

    What is used more than once is bound by ``transform`` over lists of one, step after step.
    Taking it out of such a list inside the expression, or a cast to an equal type, would
    be paid for again at each value."""
    no_texts, no_paths, no_attribute = F.array().cast("array<array<string>>"), F.array().cast(f"array<{_CATEGORY}>"), F.lit(None).cast(ATTRIBUTE)

    def value(kind: Column, texts: Column = no_texts, paths: Column = no_paths, own: Column = no_attribute) -> Column:
        return F.struct(kind.alias("kind"), texts.alias("texts"), paths.alias("paths"), own.alias("attribute"))

    no_value = value(F.lit(None).cast("string"))

    def attribute() -> Column:
        string = lambda name: F.when(F.schema_of_variant(_member(v, name)) == "STRING", F.try_variant_get(_member(v, name), "$", "string"))
        return value(F.lit("attribute"), own=F.struct(string("name").alias("name"), string("code").alias("code"), string("value").alias("value")))

    def inner_lists() -> Column:
        inner = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("ARRAY"))
        return F.filter(_typed_lists(inner), lambda x: x["kind"].isNotNull())

    def of_list(x: Column) -> Column:
        flat, kind = x["flat"], F.get(x["nested"], F.lit(0))["kind"]
        alike = F.filter(x["nested"], lambda y: y["kind"] == kind)
        return (
            F.when(flat["kind"] == "path", value(F.lit("path"), paths=F.array(flat["path"])))
            .when(flat["kind"].isNotNull(), value(F.concat(flat["kind"], F.lit("[]")), F.array(flat["texts"])))
            .when(kind == "path", value(F.lit("path[]"), paths=alike["path"]))
            .when(kind.isNotNull(), value(F.concat(kind, F.lit("[][]")), alike["texts"]))
            .otherwise(no_value)
        )

    def scalar(kind: Column) -> Column:
        return value(kind, F.array(F.array(F.try_variant_get(v, "$", "string"))))

    def of_other(schema: Column) -> Column:
        return (
            F.when(schema == "BIGINT", scalar(F.when(F.try_variant_get(v, "$", "bigint").between(-_INT, _INT - 1), "int").otherwise("long")))
            .when(schema.isin("STRING", "BOOLEAN"), scalar(F.lit("string")))
            .when(_is_double(schema), scalar(F.lit("double")))
            .when(schema == "VOID", value(F.lit("null")))
            .when(_has_scalar(v, "name") & _has_scalar(v, "value"), attribute())
            .otherwise(no_value)
        )

    both = F.transform(_typed_lists(F.array(v)), lambda flat: F.struct(flat.alias("flat"), F.when(flat["kind"].isNull(), inner_lists()).alias("nested")))
    is_list = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    return F.when(is_list, F.transform(both, of_list)).otherwise(F.transform(F.array(F.schema_of_variant(v)), of_other))


def properties(json_text: Column) -> Column:
    """The properties of a JSON object; null for what is no object."""
    return F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")


def typed_data(json_text: Column) -> Column:
    """The properties of a JSON object with their typed values; null for what is no object."""
    return F.transform_values(properties(json_text), lambda _, v: F.get(typed_values(v), F.lit(0)))


def original_form(indexed: DataFrame, parts: list[str]) -> DataFrame:
    """Maps of an indexed item put together again; of equal keys the first part's value counts."""
    out: Column = F.col(parts[0])
    for p in parts[1:]:
        out = F.map_zip_with(out, F.col(p), lambda _, a, b: F.coalesce(a, b))
    return indexed.select("doc_id", out.alias("data"))


def point_get(docs: DataFrame, doc_id) -> DataFrame:
    return docs.filter(F.col("doc_id") == doc_id)

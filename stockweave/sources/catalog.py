"""Products made of the relational tables.

A part is a product: title, brand, type, size, price, and a category path of its
type and the last word of its name.  Its line items are variants, numbered by
all their columns.  ``facet_values`` is the exploded layout that filters and
facets work on: one row per product, level and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.concat_ws("/", "p_type", F.regexp_extract("p_name", r"([^ ]+)$", 1)).alias("path"),
    )


def variants(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """``numbered=False`` spares the sort where positions don't matter."""
    v = table(spark, sf_dir, "lineitem")
    columns = [F.col("l_partkey").alias("doc_id")]
    if numbered:
        columns.append((F.row_number().over(Window.partitionBy("l_partkey").orderBy(*ORDER)) - 1).alias("variant_pos"))
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    return v.select(*columns, F.col("l_returnflag").alias("color"), F.col("l_linestatus").alias("status"), price.alias("price"), F.col("l_quantity").alias("stock"), F.col("l_shipdate").alias("shipped"))


def _entry(kind: str, name: str, value, number=None):
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lower(value.cast("string")).alias("value_norm"),
        (number.cast("double") if number is not None else F.lit(None).cast("double")).alias("num_value"),
    )


def facet_values(master: DataFrame, child: DataFrame | None = None) -> DataFrame:
    """Exploded values; ``variant_pos`` is null on the master level.  One pass over each side."""
    entries = F.array(
        _entry("term", "brand", F.col("brand")), _entry("term", "type", F.col("type")), _entry("number", "size", F.col("size"), F.col("size")),
        _entry("number", "price", F.col("price"), F.col("price")), _entry("path", "category", F.col("type")), _entry("path", "category", F.col("path")),
    )
    out = master.select("doc_id", F.lit(None).cast("int").alias("variant_pos"), F.explode(entries).alias("e")).select("doc_id", "variant_pos", "e.*")
    if child is not None:
        own = F.array(_entry("term", "color", F.col("color")), _entry("term", "status", F.col("status")), _entry("number", "variant_price", F.col("price"), F.col("price")))
        out = out.unionByName(child.select("doc_id", "variant_pos", F.explode(own).alias("e")).select("doc_id", "variant_pos", "e.*"))
    return out


#: The same tables for the oracle.
SQL = """
items AS (SELECT p_partkey AS doc_id, p_name AS title, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price,
  p_type || '/' || regexp_extract(p_name, '([^ ]+)$', 1) AS path FROM part),
variants AS (SELECT l_partkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS INTEGER) AS variant_pos,
  l_returnflag AS color, l_linestatus AS status, floor(l_extendedprice / l_quantity) AS price, l_quantity AS stock, l_shipdate AS shipped FROM lineitem),
fv AS (
  SELECT doc_id, CAST(NULL AS INTEGER) AS variant_pos, 'term' AS kind, 'brand' AS name, brand AS value, lower(brand) AS value_norm, CAST(NULL AS DOUBLE) AS num_value FROM items
  UNION ALL SELECT doc_id, NULL, 'term', 'type', type, lower(type), NULL FROM items
  UNION ALL SELECT doc_id, NULL, 'number', 'size', CAST(size AS VARCHAR), CAST(size AS VARCHAR), size FROM items
  UNION ALL SELECT doc_id, NULL, 'number', 'price', CAST(price AS VARCHAR), CAST(price AS VARCHAR), price FROM items
  UNION ALL SELECT doc_id, NULL, 'path', 'category', type, lower(type), NULL FROM items
  UNION ALL SELECT doc_id, NULL, 'path', 'category', path, lower(path), NULL FROM items
  UNION ALL SELECT doc_id, variant_pos, 'term', 'color', color, lower(color), NULL FROM variants
  UNION ALL SELECT doc_id, variant_pos, 'term', 'status', status, lower(status), NULL FROM variants
  UNION ALL SELECT doc_id, variant_pos, 'number', 'variant_price', CAST(price AS VARCHAR), CAST(price AS VARCHAR), price FROM variants)
"""

"""WARC: resolution of not-modified revisits.

A revisit record says that a server answered 304: the body is that of the latest
earlier full response to the same canonical URL.  The validators are checked: an
entity tag or, without one, a modification date that the revisit names must be
the response's.  The header fields that a 304 may update (RFC 9110, 15.4.5) are
taken from the revisit, all others from the response.

The as-of join is made of windows in two steps, so a URL of a third of all
records doesn't meet in one task: records are split by canonical URL *and* a
range of time, in which the latest response so far is carried along; the last
response of each range (at most one row per URL and range) is carried from range
to range; the two are put together.  Ranges hold about equally many records and
grow in number with them.  Bodies take no part in it; they are joined by record
at the end.

Edge cases.  A null or empty URL, or a null time, never resolves.  Responses at
the time of a revisit are not earlier.  Of responses at one time, that with the
largest id counts, and of those the one with the largest hash of its contents;
so rows that repeat an id with other contents are records of their own.  Repeated
rows are kept, one result each.  A revisit without validators is accepted.  Field
names don't differ by case; of names that differ in case only, the first in code
point order (capitals first) counts.  Null headers are none.  A null body stays
null.  An empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

RANGES, MOST_RANGES = 64, 1024
#: Records of a range, from which on there are more than ``RANGES`` of them.
RANGE_RECORDS = 1 << 22
#: Header fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Patterns used in order; the host is put in lower case afterwards.
CANONICAL = (
    (r"#.*$", ""),
    (r"^(?i:https?)://", ""),
    (r"^(?i:www)[0-9]*\.", ""),
    (r"^([^/?]*):(80|443)([/?]|$)", "$1$3"),
    (r"([?&])(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*", "$1"),
    (r"&&+", "&"),
    (r"\?&", "?"),
    (r"[?&]+$", ""),
    (r"/index\.html?($|\?)", "/$1"),
    (r"/+($|\?)", "$1"),
)


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, ``www``, default port, tracking parameters, index page,
    closing slash and the host's case don't tell pages apart; a path's case does."""
    out = F.trim(url)
    for pattern, by in CANONICAL:
        out = F.regexp_replace(out, pattern, by)
    out = F.concat(F.lower(F.regexp_extract(out, r"^[^/?]*", 0)), F.regexp_replace(out, r"^[^/?]*", ""))
    return F.nullif(out, F.lit(""))


def folded(headers: Column) -> Column:
    """Header fields by lower-case name."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def _range_of(time: Column, bounds: list) -> Column:
    """Number of bounds that are not above the time, by halving."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(time >= F.lit(bounds[middle]), among(middle + 1, hi)).otherwise(among(lo, middle))

    return among(0, len(bounds))


def latest_earlier(records: DataFrame, key: str, time: str, ranges: int | None = None) -> DataFrame:
    """As-of join within one table: for each row, ``source`` is the largest
    ``(time, id, content)`` of the rows of the same key with ``is_source`` and an
    earlier time.  ``records`` has ``key, time, id, content, is_source``; rows with
    a null key or time get null."""
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    if ranges is None:
        n = records.filter(known).count()
        ranges = min(MOST_RANGES, max(RANGES, -(-n // RANGE_RECORDS)))
    cuts = records.filter(known).agg(F.percentile_approx(time, [i / ranges for i in range(1, ranges)], F.lit(20 * ranges)).alias("cuts")).first().cuts
    own = F.struct(F.col(time).alias("t"), F.col("id").alias("id"), F.col("content").alias("content"))
    rows = records.filter(known).withColumn("__range", _range_of(F.col(time), sorted(set(cuts or [])))).withColumn("__own", F.when(F.col("is_source"), own))
    # "Earlier" leaves out equal times: the frame ends one before the time.
    here = F.max("__own").over(Window.partitionBy(key, "__range").orderBy(time).rangeBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(key, "__range").agg(F.max("__own").alias("__last"))
    before = ends.withColumn("__before", F.max("__last").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    carried = before.filter(F.col("__before").isNotNull()).select(F.col(key).alias("__key"), F.col("__range").alias("__at"), "__before")
    joined = rows.withColumn("__here", here).join(carried, (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__at")), "left")
    found = joined.withColumn("source", F.coalesce("__here", "__before")).drop("__range", "__own", "__here", "__key", "__at", "__before")
    return found.unionByName(records.filter(~known).withColumn("source", F.lit(None).cast(found.schema["source"].dataType)))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields with those of the update that a 304 may change; both folded."""
    return F.map_zip_with(stored, F.map_filter(update, lambda k, _: k.isin(*PERMITTED)), lambda _, a, b: F.coalesce(b, a))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the revisits of a table of records.

    ``records``: ``record_id long, url string, captured long, is_response
    boolean, headers map<string,string>, body string``.  One row per revisit:
    ``record_id, canonical_url, captured, source_id`` (null if there is no
    earlier response), ``valid`` (validators agree), and for valid ones
    ``headers`` and ``body``.
    """
    entries = F.array_sort(F.map_entries("headers"))
    is_source = F.coalesce("is_response", F.lit(False))
    content = F.xxhash64("record_id", "url", "captured", entries, "body")
    # Read five times, so computed once; it is small beside the bodies.
    slim = records.select(canonical_url(F.col("url")).alias("canonical_url"), "captured", F.col("record_id").alias("id"), content.alias("content"), is_source.alias("is_source"))
    found = (
        latest_earlier(frames.keep(slim), "canonical_url", "captured")
        .filter(~F.col("is_source"))
        .select(F.col("id").alias("record_id"), "content", "canonical_url", "captured", F.col("source.id").alias("source_id"), F.col("source.content").alias("source_content"))
    )
    revisit = records.filter(~is_source).select(content.alias("__rc"), folded(F.col("headers")).alias("__update")).dropDuplicates(["__rc"])
    response = records.filter(is_source).select(content.alias("__sc"), folded(F.col("headers")).alias("__stored"), F.col("body").alias("__body")).dropDuplicates(["__sc"])
    # One key on either side, so a body is dealt out once, for both steps.
    both = found.join(revisit, F.col("content") == F.col("__rc"), "left").join(response, F.col("source_content") == F.col("__sc"), "left")
    tag, old = F.element_at("__update", "etag"), F.element_at("__stored", "etag")
    date, old_date = F.element_at("__update", "last-modified"), F.element_at("__stored", "last-modified")
    agree = F.when(tag.isNotNull(), tag.eqNullSafe(old)).when(date.isNotNull(), date.eqNullSafe(old_date)).otherwise(F.lit(True))
    valid = F.col("source_content").isNotNull() & agree
    return both.select(
        "record_id", "canonical_url", "captured", "source_id", valid.alias("valid"),
        F.when(valid, merged_headers(F.col("__stored"), F.col("__update"))).alias("headers"),
        F.when(valid, F.col("__body")).alias("body"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of the table ``pages``: each page is a full response, and is
    asked for again ``length(html)`` steps later with the entity tag it had."""
    tag = F.md5(F.col("html"))
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("captured"), F.lit(True).alias("is_response"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("body"),
    )
    delay = F.coalesce(F.length("html"), F.lit(0))
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * (F.col("page_id") + delay) + 1).alias("captured"), F.lit(False).alias("is_response"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("none"), F.lit("date"), (F.col("page_id") + delay).cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)

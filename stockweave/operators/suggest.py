"""Suggest: staged completion over records ``(text, secondary, weight, tags)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), ""), lambda x: x.rlike(r"\p{L}"))


def common_chars(c: Column, query: str) -> Column:
    """Letters in common, as multisets, by the longer one's number; 1 if equal, 0 if empty."""
    c, query = F.trim(c), query.strip()
    mine = [x for x in query.lower() if x.isalpha()]
    own = letters(c)
    shared = reduce(Column.__add__, [F.least(F.size(F.filter(own, lambda x: x == a)), F.lit(mine.count(a))) for a in sorted(set(mine))], F.lit(0))
    longer = F.greatest(F.size(own), F.lit(len(mine)))
    return F.when(F.lower(c) == query.lower(), 1.0).when(longer == 0, 0.0).otherwise(shared / longer)


def prefix_length(c: Column, query: str) -> Column:
    """Length of the common beginning; if none, that of the best later word."""
    def common(w: Column) -> Column:
        return reduce(lambda n, k: F.when(F.lower(F.substring(w, F.lit(1), F.lit(k))) == query[:k].lower(), F.lit(k)).otherwise(n), range(1, len(query) + 1), F.lit(0))

    later = F.transform(F.slice(F.split(c, r"\s+"), 2, 100), common)
    return F.when(common(c) > 0, common(c)).otherwise(F.coalesce(F.array_max(later), F.lit(0)))


def fuzzy_order(label: str, query: str) -> list[Column]:
    return [F.col("prefix").desc(), F.col("common").desc(), F.col("weight").desc(), F.col(label)]


def default_order(label: str) -> list[Column]:
    return [F.col("stage"), F.col("weight").desc(), F.col("common").desc(), F.col(label)]


def suggest(records: DataFrame, query: str, limit: int = 10, tag: str | None = None, sharpened: dict[str, list[str]] | None = None, relaxed: dict[str, list[str]] | None = None) -> DataFrame:
    """Suggestions by stage until the limit: sharpened, infix in the text, infix in
    the secondary text, one edit, two edits (three letters or more, and only if
    nothing was found yet), two words glued, relaxed.  A text counts in its first
    stage.  ``text, stage, weight``."""
    q = " ".join(query.lower().split())
    rows = records if tag is None else records.filter(F.array_contains("tags", tag))
    text = F.lower("text")
    infix = lambda c: c.startswith(q) | F.contains(c, F.lit(" " + q))
    near = lambda k: F.exists(F.split(text, r"\s+"), lambda w: F.levenshtein(F.substring(w, F.lit(1), F.lit(len(q) + k)), F.lit(q), k) >= 0)
    stage = F.when(text.isin(*(sharpened or {}).get(q, [""])), 0).when(infix(text), 1).when(infix(F.lower(F.coalesce("secondary", F.lit("")))), 2)
    stage = stage.when(near(1), 3)
    if len(q) >= 3:
        stage = stage.when(near(2), 4)
    stage = stage.when(F.contains(F.replace(text, F.lit(" "), F.lit("")), F.lit(q.replace(" ", ""))), 5).when(text.isin(*(relaxed or {}).get(q, [""])), 6)
    found = rows.withColumn("stage", stage).filter("stage IS NOT NULL").withColumn("common", common_chars(F.col("text"), q))
    found = found.groupBy("text").agg(F.min("stage").alias("stage"), F.max("weight").alias("weight"), F.max("common").alias("common"))
    # Two edits count only if no stage before found anything.
    least = found.agg(F.min("stage").alias("__least"))
    found = found.join(F.broadcast(least), (F.col("stage") != 4) | (F.col("__least") == 4))
    return found.orderBy(*default_order("text")).limit(limit).select("text", "stage", "weight")


def _by_share(total: int, shares: dict[str, float]) -> dict[str, int]:
    """A number dealt out by shares; what rounding leaves goes by the largest fractions, then the largest shares, then names."""
    whole = sum(shares.values())
    exact = {g: total * s / whole for g, s in shares.items()} if whole else dict.fromkeys(shares, 0.0)
    out = {g: int(x) for g, x in exact.items()}
    order = sorted(shares, key=lambda g: (-round(exact[g] - out[g], 9), -shares[g], g or ""))
    for g in order[: total - sum(out.values()) if whole else 0]:
        out[g] += 1
    return out


def allot(shares: dict[str, float], available: dict[str, int], limit: int) -> dict[str, int]:
    """How many of each group: by share, and what a group can't fill goes to the others by
    their shares, until the limit is reached or nothing is left."""
    out, open_groups, left = dict.fromkeys(shares, 0), {g: s for g, s in shares.items() if s > 0 and available.get(g, 0) > 0}, limit
    while left > 0 and open_groups:
        for g, n in _by_share(left, open_groups).items():
            out[g] = min(available[g], out[g] + n)
        left = limit - sum(out.values())
        open_groups = {g: s for g, s in open_groups.items() if out[g] < available[g]}
    return out


def group_limit(rows: DataFrame, group: str, shares: dict[str, float], limit: int, prefetch: float | None = None) -> DataFrame:
    """The limit shared out to groups, the heaviest rows of each first.

    Groups without a share have the rest of them together (1 less all shares).  With
    ``prefetch``, only so many times the limit of the heaviest rows are looked at."""
    if prefetch is not None:
        rows = rows.orderBy(F.col("weight").desc(), "text").limit(int(limit * prefetch))
    name = F.when(F.col(group).isin(*shares), F.col(group))
    ranked = rows.withColumn("__g", name).withColumn("__r", F.row_number().over(Window.partitionBy("__g").orderBy(F.col("weight").desc(), "text"))).filter(F.col("__r") <= limit)
    have = {r["__g"]: r["count"] for r in ranked.groupBy("__g").count().collect()}  # a row for each configured group
    most = allot({**shares, None: max(0.0, 1 - sum(shares.values()))} if None in have else shares, have, limit)
    cut = F.coalesce(*[F.when(F.col("__g").eqNullSafe(F.lit(g)), F.lit(n)) for g, n in most.items()], F.lit(0))
    return ranked.filter(F.col("__r") <= cut).drop("__g", "__r")


def dedupe(rows: DataFrame, group: str, priority: list[str]) -> DataFrame:
    """One of each normalised text: that of the group which comes first."""
    order = F.coalesce(*[F.when(F.col(group) == g, F.lit(i)) for i, g in enumerate(priority)], F.lit(len(priority)))
    key = F.lower(F.trim("text"))
    best = rows.groupBy(key.alias("norm")).agg(F.min_by(F.struct("text", group, "weight"), F.struct(order, -F.col("weight"), F.col("text"))).alias("b"))
    return best.select("b.*")


def source(values: DataFrame, name: str, limit: int = 1000) -> DataFrame:
    """Records of a field's values: the text, and as weight its number of products."""
    n = values.filter(F.col("name") == name).groupBy(F.col("value").alias("text")).agg(F.countDistinct("doc_id").alias("weight"))
    return n.orderBy(F.col("weight").desc(), "text").limit(limit)

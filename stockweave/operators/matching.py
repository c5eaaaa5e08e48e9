"""Text matching and relevance.

A field is an array of tokens.  A term's matches are found on that array, so one
query over one field is one scan without a shuffle; document frequencies are one
aggregate.  For many queries at once there is the stored index of :mod:`postings`."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def has(tokens: Column, term: str) -> Column:
    return F.array_contains(tokens, term)


def frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def min_should_match(spec: str, n: int) -> int:
    """``3``, ``-1``, ``70%``, ``-25%`` or ``2<80%``: all up to two terms, then 80 %."""
    spec = spec.strip()
    if "<" in spec:
        bound, rest = spec.split("<", 1)
        return n if n <= int(bound) else min_should_match(rest, n)
    part = int(n * abs(int(spec[:-1])) / 100) if spec.endswith("%") else abs(int(spec))
    k = n - part if spec.startswith("-") else part
    return max(1 if n else 0, min(n, k))


def match_count(tokens: Column, terms: list[str]) -> Column:
    return reduce(Column.__add__, [has(tokens, t).cast("int") for t in terms], F.lit(0))


def match(docs: DataFrame, tokens: Column, terms: list[str], spec: str = "100%") -> DataFrame:
    """Documents with enough of the terms: ``matched`` is their number."""
    return docs.withColumn("matched", match_count(tokens, terms)).filter(F.col("matched") >= min_should_match(spec, len(terms)))


def term_counts(docs: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """Adds ``__len`` and ``__tf0 ..``, all that scoring needs of the tokens."""
    return docs.select("*", F.size(tokens).alias("__len"), *[frequency(tokens, t).alias(f"__tf{i}") for i, t in enumerate(terms)])


def bm25_counted(counted: DataFrame, n_terms: int, weight: float = 1.0) -> DataFrame:
    """``score`` from :func:`term_counts`; one aggregate gives what all documents share."""
    tf = [F.col(f"__tf{i}") for i in range(n_terms)]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)]).first()
    norm = K1 * (1 - B + B * F.col("__len") / F.lit(stats.avg or 1.0))
    parts = [F.lit(weight * math.log(1 + (stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))) * c * (K1 + 1) / (c + norm) for i, c in enumerate(tf)]
    return counted.withColumn("score", reduce(Column.__add__, parts, F.lit(0.0))).drop("__len", *[f"__tf{i}" for i in range(n_terms)])


def bm25(docs: DataFrame, tokens: Column, terms: list[str], weight: float = 1.0) -> DataFrame:
    """Adds ``score``.  Where tokenising is dear, keep :func:`term_counts` as a table
    and score that, so that texts are read once."""
    return bm25_counted(term_counts(docs, tokens, terms), len(terms), weight)


def cross_fields(fields: dict[str, Column], terms: list[str], weights: dict[str, float]) -> Column:
    """Each term in its best field, terms summed."""
    best = [F.greatest(*[F.when(has(f, t), F.lit(weights[n])).otherwise(0.0) for n, f in fields.items()], F.lit(0.0)) for t in terms]
    return reduce(Column.__add__, best)


def best_fields(fields: dict[str, Column], terms: list[str], weights: dict[str, float], tie: float = 0.0) -> Column:
    """Per field the sum, then the best field plus a share of the others."""
    sums = [reduce(Column.__add__, [F.when(has(f, t), F.lit(weights[n])).otherwise(0.0) for t in terms]) for n, f in fields.items()]
    return dis_max(sums, tie)


def dis_max(scores: list[Column], tie: float = 0.0) -> Column:
    top = F.greatest(*scores, F.lit(0.0))
    return top + F.lit(tie) * (reduce(Column.__add__, scores) - top)


def phrase(tokens: Column, words: list[str], slop: int = 0) -> Column:
    """The words in order, with at most ``slop`` others between neighbours."""
    n = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _follows(tokens, i, words, slop))
    return (n > 0) & (F.size(starts) > 0)


def _follows(tokens: Column, i: Column, words: list[str], slop: int) -> Column:
    if slop == 0:
        return reduce(Column.__and__, [F.coalesce(F.get(tokens, i + k) == w, F.lit(False)) for k, w in enumerate(words)])
    head = F.get(tokens, i) == words[0]
    window = F.slice(tokens, i + 2, F.lit(len(words) - 1 + slop))
    return F.coalesce(head & reduce(Column.__and__, [F.array_contains(window, w) for w in words[1:]], F.lit(True)), F.lit(False))


def phrase_prefix(tokens: Column, words: list[str]) -> Column:
    last = F.exists(tokens, lambda t: t.startswith(words[-1]))
    return last if len(words) == 1 else last & reduce(Column.__and__, [has(tokens, w) for w in words[:-1]])


def fuzziness(term: str) -> int:
    """AUTO: no edit up to two letters, one up to five, then two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def fuzzy(tokens: Column, term: str, edits: int | None = None) -> Column:
    k = fuzziness(term) if edits is None else edits
    near = lambda t: (F.abs(F.length(t) - len(term)) <= k) & (F.levenshtein(t, F.lit(term), k) >= 0)
    return F.exists(tokens, near)


def fuzzy_default(fields: dict[str, Column], terms: list[str], weights: dict[str, float], spec: str = "2<80%", tie: float = 0.8) -> tuple[Column, Column]:
    """The default strategy: each term with AUTO edits in any field, enough of them,
    a term's score that of its best field and a share of the others'."""
    hits = [{n: fuzzy(c, t) for n, c in fields.items()} for t in terms]
    scores = [dis_max([F.when(h, F.lit(float(weights[n]))).otherwise(0.0) for n, h in of.items()], tie) for of in hits]
    matched = reduce(Column.__add__, [reduce(Column.__or__, of.values()).cast("int") for of in hits], F.lit(0))
    return matched >= min_should_match(spec, len(terms)), reduce(Column.__add__, scores, F.lit(0.0))


def match_any(fields: dict[str, Column], terms: list[str], weights: dict[str, float], tie: float = 0.2) -> tuple[Column, Column]:
    """Any term in any field: whether, and the best field's score with a share of the others'."""
    sums = [match_count(c, terms) * F.lit(float(weights[n])) for n, c in fields.items()]
    score = dis_max(sums, tie)
    return score > 0, score


def phrase_boosted(tokens: Column, quoted: Column | None, terms: list[str], whole: float = 1.5, single: float = 1.1) -> Column:
    """Terms, plus the whole query as a phrase, plus the single terms as they are
    written, if quoted text is analysed otherwise (``quoted``) and there are several."""
    exact = tokens if quoted is None else quoted
    score = match_count(tokens, terms) + F.when(phrase(exact, terms), F.lit(whole)).otherwise(0.0)
    if quoted is not None and len(terms) > 1:
        score = score + F.lit(single) * match_count(quoted, terms)
    return score


def shingle_variants(tokens: Column, terms: list[str], glued: float = 2.0, variant: float = 0.9) -> Column:
    """The best of the query and its variants: each adjacent pair as one word."""
    best = [match_count(tokens, terms).cast("double")]
    for i in range(len(terms) - 1):
        others = match_count(tokens, terms[:i] + terms[i + 2 :])
        best.append(F.lit(variant) * (F.lit(glued) * has(tokens, terms[i] + terms[i + 1]).cast("int") + others))
    return F.greatest(*best, F.lit(0.0))


def union_should(parts: list[DataFrame]) -> DataFrame:
    """``doc_id, score`` of results: any of them, scores summed."""
    return reduce(DataFrame.unionByName, [p.select("doc_id", "score") for p in parts]).groupBy("doc_id").agg(F.sum("score").alias("score"))


def and_merge(parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Conditions with scores as one: all hold, scores summed."""
    return reduce(Column.__and__, [c for c, _ in parts]), reduce(Column.__add__, [s for _, s in parts])


def trigram_share(word: Column, query: str) -> Column:
    """Share of the query's trigrams that a text has."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)}) or [query]
    return reduce(Column.__add__, [F.contains(word, F.lit(g)).cast("int") for g in grams]) / F.lit(float(len(grams)))


def spell_corrections(dictionary: DataFrame, terms: list[str], least: float = 0.75) -> DataFrame:
    """``term, correction``: of similar words the best by similarity, then frequency.

    ``dictionary`` is ``(word, n)``; terms are a query's, so each word is compared
    with a few, only with those of about its length."""
    listed = F.array(*[F.lit(t) for t in terms])
    pair = dictionary.withColumn("term", F.explode(listed)).filter((F.abs(F.length("word") - F.length("term")) <= 2) & (F.col("word") != F.col("term")))
    score = 1 - F.levenshtein("word", "term") / F.greatest(F.length("word"), F.length("term"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("n").desc(), "word"))
    best = pair.withColumn("score", score).filter(F.col("score") >= least).withColumn("r", rank).filter("r = 1")
    return best.select("term", F.col("word").alias("correction"), F.round("score", 6).alias("score"))


def term_mask(tokens: Column, terms: list[str], corrections: dict[str, str] | None = None) -> Column:
    """Bits of the terms that a document has, as they are, corrected, or glued to a neighbour."""
    bits = []
    for i, t in enumerate(terms):
        forms = [t, *[c for k, c in (corrections or {}).items() if k == t]]
        forms += [terms[i - 1] + t] if i else []
        forms += [t + terms[i + 1]] if i + 1 < len(terms) else []
        bits.append(F.when(F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in forms])), F.lit(1 << i)).otherwise(0))
    return reduce(Column.__add__, bits)


def cooccurrence(docs: DataFrame, tokens: Column, terms: list[str], corrections: dict[str, str] | None = None) -> DataFrame:
    """Number of documents for each exact subset of the terms, as a bit mask."""
    return docs.select(term_mask(tokens, terms, corrections).alias("mask")).filter("mask > 0").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


DESIRED = 12


def predicted(docs: DataFrame, tokens: Column, terms: list[str], corrections: dict[str, str] | None = None, desired: int = DESIRED) -> DataFrame:
    """The best combinations of terms until they have ``desired`` matches together:
    the documents of any of them, ``score`` being their number of terms."""
    counts = [(r["mask"], r["n"]) for r in cooccurrence(docs, tokens, terms, corrections).collect()]  # at most 2 ** terms rows
    chosen, total = [], 0
    for p in predicted_queries(counts, terms, frozenset(corrections or ())):
        if total >= desired:
            break
        chosen.append(p["mask"])
        total += p["matches"]
    mask = F.col("__mask")
    hit = reduce(Column.__or__, [mask.bitwiseAND(F.lit(m)) == m for m in chosen], F.lit(False))
    return docs.withColumn("__mask", term_mask(tokens, terms, corrections)).filter(hit).withColumn("score", F.bit_count("__mask").cast("double")).drop("__mask")


def predicted_queries(counts: list[tuple[int, int]], terms: list[str], corrected: frozenset[str] = frozenset()) -> list[dict]:
    """Term combinations with matches, the best first: all terms, more original
    terms, more corrections, fewer matches."""
    full = (1 << len(terms)) - 1
    out = []
    for mask, _ in counts:
        chosen = [t for i, t in enumerate(terms) if mask >> i & 1]
        total = sum(n for m, n in counts if m & mask == mask)
        out.append({"mask": mask, "terms": chosen, "matches": total, "all": mask == full, "original": sum(t not in corrected for t in chosen), "corrected": sum(t in corrected for t in chosen)})
    return sorted(out, key=lambda p: (not p["all"], -p["original"], -p["corrected"], p["matches"], p["mask"]))


def relaxed(docs: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """Every combination with as many terms as the best one; unmatched terms only add to the score."""
    counts = [(r.mask, r.n) for r in cooccurrence(docs, tokens, terms).collect()]  # at most 2 ** terms rows
    best = max((bin(m).count("1") for m, _ in counts), default=0)
    return docs.withColumn("matched", match_count(tokens, terms)).filter((F.col("matched") >= best) & (F.col("matched") > 0))

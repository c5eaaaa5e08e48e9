"""Text analysis: tokens of indexed texts and of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import asciify

#: Words that the language analyzers drop.
STOP_WORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "de": "aber als am an auch auf aus bei bin bis da das dem den der des die ein eine einem einen einer es für hat ich im in ist mit nicht oder sie sind und von war wie wir zu zum zur".split(),
}
#: Endings that the light stemmers take off, longest first.
ENDINGS = {"en": ("ings", "ing", "ies", "es", "ed", "s"), "de": ("ern", "em", "en", "er", "es", "e", "n", "s")}
#: One letter to two.
GERMAN = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Characters that bind a word in a query.
BIND = "-_.&+'/"


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(c, r"<[^>]*>|&[a-z]+;|&#[0-9]+;", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def minimal(c: Column) -> Column:
    """HTML off, lower case, what isn't a letter or digit becomes a space."""
    return words(F.regexp_replace(F.lower(strip_html(c)), r"[^\p{L}\p{N}]+", " "))


def german_characters(c: Column) -> Column:
    for a, b in GERMAN:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def stem(w: Column, lang: str) -> Column:
    """A light stemmer: one ending off, if at least four letters stay."""
    out = w
    for end in reversed(ENDINGS[lang]):
        out = F.when(w.endswith(end) & (F.length(w) >= len(end) + 4), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
    return out


def standard(c: Column, lang: str = "en") -> Column:
    """Lower case, stop words out, light stems; German letters spelled out."""
    tokens = words(F.regexp_replace(F.lower(strip_html(c)), r"[^\p{L}\p{N}]+", " "))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS[lang]])
    tokens = F.filter(tokens, lambda w: ~F.array_contains(stop, w))
    if lang == "de":
        tokens = F.transform(tokens, german_characters)
    return F.transform(tokens, lambda w: stem(w, lang))


def shingle(tokens: Column) -> Column:
    """Neighbours glued together."""
    n = F.size(tokens) - 1
    glued = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(n >= 1, glued).otherwise(F.array().cast("array<string>"))


def ngrams(word: Column, size: int = 3) -> Column:
    n = F.length(word) - (size - 1)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(word, i, F.lit(size)))
    return F.when(n >= 1, many).otherwise(F.array().cast("array<string>"))


def query_terms(q: Column) -> Column:
    return words(F.trim(F.lower(q)))


def query_shingles(q: Column) -> Column:
    """Terms, each followed by itself glued to the next."""
    t = query_terms(q)
    return F.flatten(F.transform(t, lambda w, i: F.when(i < F.size(t) - 1, F.array(w, F.concat(w, F.get(t, i + 1)))).otherwise(F.array(w))))


def strip_nonalnum(q: Column) -> Column:
    bind = "".join("\\" + c for c in BIND)
    return F.trim(F.regexp_replace(q, rf"[^\p{{L}}\p{{N}}{bind}]+", " "))


def query_asciify(q: Column) -> Column:
    return asciify(q)


def escape(q: Column) -> Column:
    """Backslash before reserved characters; ``<`` and ``>`` go; a dash only where a term begins."""
    q = F.regexp_replace(q, r"[<>]", "")
    q = F.regexp_replace(q, r'([+=&|!(){}\[\]^"~*?:\\/])', r"\\$1")
    return F.regexp_replace(q, r"(^|\s)-", r"$1\\-")


def dedupe_adjacent(tokens: Column) -> Column:
    return F.filter(tokens, lambda w, i: (i == 0) | (w != F.coalesce(F.get(tokens, i - 1), F.lit(""))))

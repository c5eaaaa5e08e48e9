"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text.

Counts are continuation counts: of a word, its distinct left neighbours, so copies
of a text count once; of a word's first five bytes, those of all its words.  An
absolute discount is taken off a class's counts; what is left of them stays with
the class, the rest is given to the next lower order: word, then beginning, then
one distribution of beginnings that both classes share, made of the counts of both.
The share of a word in its beginning's is of the counts of both, too.  So a word
too seldom to tell has almost the same probability in either model.  The larger
class's discount is greater by its size, else the absence of any rare word from the
smaller class would be a sign.

A document's score is a logistic function of the two classes' log-likelihood ratio
normalised by length and by its root.  Of each token's ratio the part between
``-margin`` and ``margin`` is left out: thousands of words that lean a little to
one class would outweigh the few that are toxic.  Discount, margin and the function
are chosen on documents of the training rows that the counts leave out in turn
(three folds).

A bigram order on top of the words was tried on the same folds and left out: chance
pairs of words that are both common outweighed it (README).

Training reads at most ``MOST_PER_CLASS`` labelled documents of each class (the
first by a hash of the id), a bound that makes the model's size independent of
the input; weights restore the classes' shares.  Scoring is one pass over all
texts without a shuffle, with the model broadcast (a few MB).

Edge cases.  Null and empty texts score as texts with ratio 0.  Labels that are
null, or whose document is missing, are not used.  Without labels of both
classes every score is the share of the one there is, or 0.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, kernel

MOST_PER_CLASS = 4000
#: Tokens of a class that the driver holds at most; documents beyond are not read.
MOST_TOKENS = 3_000_000
PREFIX_BYTES = 5
FOLDS = 3
#: Absolute discounts and margins tried.
DISCOUNTS = (0.75, 1.5, 3.0, 6.0)
MARGINS = (1.5, 2.0, 2.5)
THRESHOLD = 0.3


def tokens(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of the words' beginnings, and each text's offsets."""
    low = kernel.lower(text)
    s, e = kernel.words(text)
    _, offsets = kernel.per_text(starts, s)
    return kernel.span_hash(low, s, e), kernel.span_hash(low, s, np.minimum(e, s + PREFIX_BYTES)), offsets


def pairs(word: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each word and the one before it (a fixed one at a text's begin) as one hash."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = np.uint64(1)
    return kernel.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Counts:
    """Counts of one class: words by distinct left neighbours, beginnings by those of their words."""

    def __init__(self, word: np.ndarray, prefix: np.ndarray, pair: np.ndarray):
        at = np.unique(pair, return_index=True)[1]
        word, prefix = word[at], prefix[at]
        self.word, first, self.word_n = np.unique(word, return_index=True, return_counts=True)
        self.word_prefix = prefix[first]
        self.prefix, self.prefix_n = np.unique(prefix, return_counts=True)


def _shared(c: list[Counts], keys: np.ndarray, level: str) -> np.ndarray:
    """Counts of both classes together."""
    out = np.zeros(len(keys))
    for one in c:
        at, found = _lookup(getattr(one, level), keys)
        if len(at) and len(getattr(one, level)):
            out += np.where(found, getattr(one, f"{level}_n")[at], 0)
    return out


def _own(c: Counts, keys: np.ndarray, level: str, discount: float) -> tuple[np.ndarray, float]:
    """What a class keeps of its counts, as shares, and the share it gives down."""
    n = getattr(c, f"{level}_n").astype(float)
    if not len(n):
        return np.zeros(len(keys)), 1.0
    at, found = _lookup(getattr(c, level), keys)
    own = np.where(found, np.maximum(n[at] - discount, 0), 0) / n.sum()
    return own, 1 - float(own.sum())


#: Count of what is new, in each distribution of shared counts.
NEW = 0.5


class Model:
    """Both classes' probabilities by word, by beginning (of its new words) and of a
    new beginning, and their log ratios, toxic to ordinary."""

    def __init__(self, toxic: Counts, ordinary: Counts, discount: float, margin: float):
        both, self.margin = [toxic, ordinary], margin
        sizes = [max(float(c.word_n.sum()), 1.0) for c in both]
        words = np.union1d(toxic.word, ordinary.word)
        prefixes = np.union1d(toxic.prefix, ordinary.prefix)
        p_at, _ = _lookup(prefixes, self._either(both, "word", "word_prefix", words))
        word_n, prefix_n = _shared(both, words, "word"), _shared(both, prefixes, "prefix")
        all_n = prefix_n.sum() + NEW
        self.p_word, self.p_new_word, self.p_new = [], [], []
        for c, size in zip(both, sizes):
            d = discount * size / min(sizes)
            own, down = _own(c, prefixes, "prefix", d)
            p_prefix = own + down * prefix_n / all_n
            own, given = _own(c, words, "word", d)
            self.p_word.append(own + given * (p_prefix * (1 / (prefix_n + NEW)))[p_at] * word_n)
            self.p_new_word.append(given * p_prefix * NEW / (prefix_n + NEW))
            self.p_new.append(given * down * NEW / all_n)
        self.word, self.prefix = words, prefixes
        ratio = lambda p: np.log(p[0]) - np.log(p[1])
        self.word_ratio, self.prefix_ratio = ratio(self.p_word).astype(np.float32), ratio(self.p_new_word).astype(np.float32)
        self.rest = float(ratio(self.p_new))

    def small(self) -> Model:
        """The ratios alone, and of words only those that the margin doesn't make 0."""
        for ratio, keys in (("word_ratio", "word"), ("prefix_ratio", "prefix")):
            keep = np.abs(getattr(self, ratio) - self.rest) > (self.margin if keys == "prefix" else -1)
            setattr(self, ratio, getattr(self, ratio)[keep])
            setattr(self, keys, getattr(self, keys)[keep])
        self.p_word = self.p_new_word = self.p_new = None
        return self

    @staticmethod
    def _either(both: list[Counts], keys: str, field: str, wanted: np.ndarray) -> np.ndarray:
        """A field of the first class that has the key."""
        out = np.zeros(len(wanted), np.uint64)
        for c in reversed(both):
            at, found = _lookup(getattr(c, keys), wanted)
            if found.any():
                out = np.where(found, getattr(c, field)[at], out)
        return out

    def ratios(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Log ratio of each token, less that of a token which says nothing."""
        at, found = _lookup(self.prefix, prefix)
        out = np.where(found, self.prefix_ratio[at], self.rest) if len(self.prefix) else np.full(len(prefix), self.rest)
        if len(self.word):
            at, found = _lookup(self.word, word)
            out = np.where(found, self.word_ratio[at], out)
        return out - self.rest

    def totals(self, word: np.ndarray, prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the log ratio, without what is inside the margin."""
        r = self.ratios(word, prefix)
        r = np.sign(r) * np.maximum(np.abs(r) - self.margin, 0)
        sums = np.concatenate(([0], np.cumsum(r)))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log ratio normalised by length and by its root, and the length."""
    m = np.maximum(n, 1)
    return np.stack((np.ones(len(n)), np.clip(total / m, -0.3, 0.3) * 10, np.clip(total / np.sqrt(m), -4, 4), np.log(m) / 5), 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small penalty on all but the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * weight.sum() / max(len(y), 1))
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_per_class: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[list, dict[int, int]]:
    """At most so many labelled documents of each class, and all labels' counts."""
    clean = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(train).dropDuplicates(["id"])
    clean = frames.keep(clean)
    counts = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = frames.union([clean.filter(F.col("y") == y).orderBy(*order).limit(most_per_class) for y in (0, 1)])
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.join(F.broadcast(chosen), "id"), counts


def train(docs: DataFrame, labels: DataFrame, label: str, training: Column, most_per_class: int = MOST_PER_CLASS, most_tokens: int = MOST_TOKENS) -> tuple[Model | None, np.ndarray]:
    sample, counts = labelled_sample(docs, labels, label, training, most_per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                word, prefix, o = tokens(text, starts)
                cut = lambda x: pa.array([x[o[i] : o[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), cut(word), cut(prefix)], names=["id", "y", "word", "prefix"])

    made = frames.keep(frames.arrow(sample.select(F.col("id").cast("long"), "text", "y"), run, "id long, y int, word binary, prefix binary"))
    rows, held = [], {0: 0, 1: 0}
    for r in made.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        if held[r.y] < most_tokens:
            rows.append((r.y, np.frombuffer(r.word, np.uint64), np.frombuffer(r.prefix, np.uint64)))
            held[r.y] += len(rows[-1][1])
    have = {y: sum(r[0] == y for r in rows) for y in (0, 1)}
    if not have[0] or not have[1]:
        total = sum(counts.values())
        share = counts.get(1, 0) / total if total else 0.0
        return None, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0])
    y = np.array([r[0] for r in rows], float)
    length = np.array([len(r[1]) for r in rows])
    offsets = np.concatenate(([0], np.cumsum(length)))
    word, prefix = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    rows.clear()
    pair = pairs(word, offsets)
    weight = np.where(y == 1, counts[1] / have[1], counts[0] / have[0]) * len(y) / sum(counts.values())
    token_y = np.repeat(y, length)
    order = np.arange(len(y))
    fold = np.zeros(len(y), np.int64)
    for k in (0, 1):
        mine = order[y == k]
        fold[mine] = np.arange(len(mine)) % FOLDS
    token_fold = np.repeat(fold, length)

    def counted(out: int | None) -> list[Counts]:
        use = [(token_y == k) & (token_fold != out if out is not None else True) for k in (1, 0)]
        return [Counts(word[u], prefix[u], pair[u]) for u in use]

    kinds = [(d, m) for d in DISCOUNTS for m in MARGINS]
    totals = np.zeros((len(kinds), len(y)))
    for f in range(FOLDS):
        c = counted(f)
        mine = np.flatnonzero(fold == f)
        at = kernel.ragged(length[mine], offsets[:-1][mine])
        o = np.concatenate(([0], np.cumsum(length[mine])))
        for d in DISCOUNTS:
            model = Model(*c, d, 0)
            for i, (other, model.margin) in enumerate(kinds):
                if other == d:
                    totals[i][mine] = model.totals(word[at], prefix[at], o)
        del c
    best = None
    for kind, total in zip(kinds, totals):
        x = features(total, length)
        beta = fit_logistic(x, y, weight)
        value = loss(x, y, weight, beta)
        if best is None or value < best[0]:
            best = (value, kind, beta)
    return Model(*counted(None), *best[1]).small(), best[2]


SCHEMA = "doc_id long, score double, log_ratio double, n_words long"


def score(docs: DataFrame, model: Model | None, beta: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of every text, with its log ratio and number of words."""
    sent = docs.sparkSession.sparkContext.broadcast((model, beta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, b_ = sent.value
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                word, prefix, offsets = tokens(text, starts)
                total = m.totals(word, prefix, offsets) if m is not None and len(word) else np.zeros(hi - lo)
                n = np.diff(offsets)
                p = 1 / (1 + np.exp(-np.clip(features(total, n) @ b_, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array(total), pa.array(n, pa.int64())], names=["doc_id", "score", "log_ratio", "n_words"])

    return frames.arrow(docs.select(F.col(id_column).cast("long"), text_column), run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, rest: int = 2, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted, log_ratio, n_words`` of every document.

    Labels of ids with crc32 mod ``fold`` equal to ``rest`` are held out."""
    model, beta = train(docs, labels, "toxic", ~frames.held_out(F.col("id"), fold, rest), **bounds)
    out = score(docs, model, beta)
    return out.select("doc_id", frames.held_out(F.col("doc_id"), fold, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_ratio", "n_words")

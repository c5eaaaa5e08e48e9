"""Quality classifier: a linear-chain conditional random field over lines.

Every ``\\n``-line with a word is good or bad.  A line's features describe its
characters and words and those of the lines before and after it; two states and
four transitions make the chain.  Forward and backward sums give each line's
probability of being good; their mean, weighted by the lines' words, is the
document's, and a logistic function of it and the length is the score.

Training starts with each line labelled as its document, fits the chain by
gradient ascent on the conditional likelihood, then takes the lines of bad
documents that look good for good ones (at least the worst stays bad) and fits
again.  It reads at most ``MOST_PER_CLASS`` labelled documents of each class (the
first by a hash of the id) and ``MOST_LINES`` lines; weights restore the classes'
shares.  Scoring is one pass over all texts, without a shuffle.

Edge cases.  Null, empty and blank texts have no line and the goodness 0.  Labels
that are null or without a document are not used.  With labels of one class
only, every score is that class's share.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernel
from .toxicity import fit_logistic, labelled_sample

MOST_PER_CLASS = 3000
MOST_LINES = 120_000
THRESHOLD = 0.3
#: A chain of more lines is run in parts that are joined exactly at their borders.
PART = 64
_CLASSES = ("upper", "lower", "digit", "symbol", "loud", "mark", "high", "other")
_KIND = np.full(256, 7, np.int8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[list(b"#*$%&|<>{}[]\\^~_=+@/")] = 3
_KIND[list(b"!?")] = 4
_KIND[list(b".,;:'\"()-")] = 5
_KIND[128:] = 6
_KIND[0x80:0xC0] = 8
_KIND[[9, 10, 11, 12, 13, 32]] = 8


def line_features(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of each line, its text, its number of words."""
    s, e = kernel.words(text)
    breaks = np.concatenate(([0], np.cumsum(text == 10)))
    in_line = breaks[s]
    if not len(s):
        return np.zeros((0, N_OWN), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], in_line[1:] != in_line[:-1])))
    n = np.diff(np.concatenate((first, [len(s)])))
    begin, end = s[first], e[np.concatenate((first[1:], [len(s)])) - 1]
    line = np.repeat(np.arange(len(first)), n)
    of = np.searchsorted(starts, begin, "right") - 1
    kind = _KIND[text]
    share = []
    characters = np.zeros(len(first))
    for k in range(8):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        share.append((sums[end] - sums[begin]).astype(float))
        characters += share[-1]
    share = np.stack(share, 1) / np.maximum(characters, 1)[:, None]
    word = kernel.span_hash(kernel.lower(text), s, e)
    same = np.zeros(len(s))
    same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    distinct = np.unique(kernel.mix(word + line.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]
    new_words = np.bincount(line[distinct], minlength=len(first))
    size = np.minimum(e - s, 60)
    mean = np.bincount(line, weights=size) / n
    short = np.bincount(line, weights=size <= 3) / n
    long = np.bincount(line, weights=size >= 9) / n
    odd_end = np.bincount(line, weights=np.isin(text[e - 1], np.frombuffer(b"#*$%&|!", np.uint8))) / n
    capital = np.bincount(line, weights=_KIND[text[s]] == 0) / n
    h = kernel.run_hash(word, first, np.concatenate((first[1:], [len(s)])))
    again = np.ones(len(first))
    again[np.unique(kernel.mix(h + of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]] = 0
    stop = np.isin(text[end - 1], np.frombuffer(b".!?", np.uint8)).astype(float)
    own = [*share.T, np.bincount(line, weights=same) / n, 1 - new_words / n, mean / 10, short, long, odd_end, capital, again, stop, np.log1p(n) / 4, (n < 4).astype(float)]
    strong = [np.minimum(5 * own[i], 1) for i in (2, 3, 4, 8, 9, 13)] + [(own[0] > 0.5).astype(float), (own[9] > 0.5).astype(float), (own[11] > 0.5).astype(float), (own[11] < 0.15).astype(float)]
    return np.stack(own + strong, 1).astype(np.float32), of, n


N_OWN = 8 + 11 + 10


def with_neighbours(own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A constant, own features, those before and after, and both edges."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    first, last = np.ones(len(own), bool), np.ones(len(own), bool)
    if len(own) > 1:
        joined = of[1:] == of[:-1]
        first[1:], last[:-1] = ~joined, ~joined
        before[1:][joined] = own[:-1][joined]
        after[:-1][joined] = own[1:][joined]
    edges = np.stack((np.ones(len(own)), first, last), 1).astype(np.float32)
    return np.concatenate((edges, own, before, after), 1)


N_FEATURES = 3 + 3 * N_OWN


def chains(of: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each text's run of lines, in parts of ``longest``."""
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(of))
    new = np.concatenate(([True], of[1:] != of[:-1]))
    if longest:
        run = at - np.maximum.accumulate(np.where(new, at, 0))
        new |= run % longest == 0
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate((begin, [len(of)])))


def _borders(psi: np.ndarray, a: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums before each part and backward sums after it, each up to a factor,
    from the products of the parts' matrices.  ``first`` marks a chain's first part."""
    before, after = np.ones((len(begin), 2)), np.ones((len(begin), 2))
    last = np.concatenate((first[1:], [True]))
    some = np.flatnonzero(~(first & last))
    if not len(some):
        return before, after
    m = np.tile(np.eye(2), (len(some), 1, 1))
    for t in range(int(length[some].max())):
        go = np.flatnonzero(length[some] > t)
        step = m[go] if not t else m[go] @ a
        if not t:
            inner = ~first[some[go]]
            step[inner] = step[inner] @ a
        step = step * psi[begin[some[go]] + t][:, None, :]
        m[go] = step / step.max((1, 2), keepdims=True)
    for j, i in enumerate(some.tolist()):
        if not last[i]:
            v = before[i] @ m[j]
            before[i + 1] = v / v.sum()
    for j, i in reversed(list(enumerate(some.tolist()))):
        if not first[i]:
            v = m[j] @ after[i]
            after[i - 1] = v / v.sum()
    return before, after


def forward_backward(node: np.ndarray, step: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line, expected transitions, and the log normaliser.

    All chains at once, the longest first, so a step works on a prefix of them.
    With ``first``, the runs are consecutive parts of chains, and those it marks
    begin one; the sums are those of the whole chains."""
    top = node.max(1)
    psi = np.exp(node - top[:, None])
    a = np.exp(step)
    first = np.ones(len(begin), bool) if first is None else first
    before, after = _borders(psi, a, begin, length, first)
    order = np.argsort(-length, kind="stable")
    begin, length, first, before, after = begin[order], length[order], first[order], before[order], after[order]
    alpha, scale = np.zeros_like(psi), np.ones(len(psi))
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]
    for t, k in enumerate(active):
        i = begin[:k] + t
        v = (alpha[i - 1] @ a if t else np.where(first[:, None], 1.0, before @ a)) * psi[i]
        scale[i] = v.sum(1)
        alpha[i] = v / scale[i][:, None]
    beta = np.ones_like(psi)
    end = begin + length - 1
    beta[end] = after / (alpha[end] * after).sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        i = begin[: active[t]] + t
        w = psi[i] * beta[i] / scale[i][:, None]
        expected += (alpha[i - 1].T @ w) * a
        beta[i - 1] = w @ a.T
    i, inner = begin[~first], ~first
    expected += (before[inner].T @ (psi[i] * beta[i] / scale[i][:, None])) * a
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), expected, float((np.log(scale) + top).sum())


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood by Adam; ``weight`` is by run, the same for a chain's."""
    theta, step = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    chain = np.repeat(np.arange(len(begin)), length)
    chain_weight = weight[chain]
    true = np.zeros((len(y), 2))
    true[np.arange(len(y)), y] = 1
    inside = np.ones(len(y), bool)
    inside[begin[first]] = False
    at = np.flatnonzero(inside)
    total = chain_weight.sum()
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[at - 1], y[at]), chain_weight[at])
    m = [np.zeros_like(theta), np.zeros_like(step)]
    v = [np.zeros_like(theta), np.zeros_like(step)]
    groups = [np.flatnonzero(weight == u) for u in np.unique(weight)]
    for t in range(1, rounds + 1):
        gamma = np.zeros((len(y), 2))
        expected = np.zeros((2, 2))
        node = np.clip(x @ theta, -30, 30)
        for g in groups:  # a chain's weight multiplies its expectations
            mine = kernel.ragged(length[g], begin[g])
            o = np.cumsum(length[g]) - length[g]
            one, moves, _ = forward_backward(node[mine], step, o, length[g], first[g])
            gamma[mine] = one
            expected += moves * weight[g[0]]
        grads = [x.T @ ((true - gamma) * chain_weight[:, None]) / total - ridge * theta, (moved - expected) / total - ridge * step]
        rate = 0.1 if t < 0.7 * rounds else 0.03
        for k, (p, g) in enumerate(zip((theta, step), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return theta, step


def goodness(text: np.ndarray, starts: np.ndarray, theta: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: weighted goodness, the lowest line's, words, lines."""
    own, of, n = line_features(text, starts)
    k = len(starts) - 1
    begin, length = chains(of)
    low, good, total = np.zeros(k), np.zeros(k), np.bincount(of, weights=n, minlength=k)
    if len(of):
        p = forward_backward(np.clip(with_neighbours(own, of) @ theta, -30, 30), step, begin, length)[0][:, 1]
        good = np.bincount(of, weights=p * n, minlength=k) / np.maximum(total, 1)
        low[of[begin]] = np.minimum.reduceat(p, begin)
    return good, low, total, np.bincount(of, minlength=k)


def score_features(good: np.ndarray, low: np.ndarray, total: np.ndarray) -> np.ndarray:
    def logit(p):
        p = np.clip(p, 1e-3, 1 - 1e-3)
        return np.log(p / (1 - p)) / 3

    return np.stack((np.ones(len(good)), logit(good), logit(low), np.log1p(total) / 5, (total < 5).astype(float)), 1)


def train(docs: DataFrame, labels: DataFrame, training, most_per_class: int = MOST_PER_CLASS, most_lines: int = MOST_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sample, counts = labelled_sample(docs, labels, "quality", training, most_per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                own, of, n = line_features(text, starts)
                o = np.searchsorted(of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), *[pa.array([x[o[i] : o[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()) for x in (own, n.astype(np.int64))]],
                    names=["id", "y", "own", "n"],
                )

    made = frames.keep(frames.arrow(sample.select(F.col("id").cast("long"), "text", "y"), run, "id long, y int, own binary, n binary"))
    rows, lines = [], {0: 0, 1: 0}
    for r in made.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        n = np.frombuffer(r.n, np.int64)
        if lines[r.y] < most_lines // 2:
            rows.append((r.y, np.frombuffer(r.own, np.float32).reshape(-1, N_OWN), n))
            lines[r.y] += len(n)
    full = [r for r in rows if len(r[2])]
    have = {y: sum(r[0] == y for r in full) for y in (0, 1)}
    if not have[0] or not have[1]:
        total = sum(counts.values())
        share = min(max(counts.get(1, 0) / total if total else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0, 0])
    doc_y = np.array([r[0] for r in full])
    size = np.array([len(r[2]) for r in full])
    of = np.repeat(np.arange(len(full)), size)
    n = np.concatenate([r[2] for r in full])
    x = with_neighbours(np.concatenate([r[1] for r in full]), of).astype(np.float64)
    begin, length = chains(of, PART)
    first = np.isin(begin, chains(of)[0])
    doc_weight = np.where(doc_y == 1, 0.5 / have[1], 0.5 / have[0]) * len(full)
    weight = doc_weight[of[begin]]
    y = doc_y[of]
    theta, step = fit(x, y, weight, begin, length, first)
    whole = chains(of)
    p = forward_backward(np.clip(x @ theta, -30, 30), step, *whole)[0][:, 1]
    worst = np.zeros(len(p), bool)
    worst[whole[0] + np.array([int(np.argmin(p[b : b + k])) for b, k in zip(*whole)])] = True
    y = np.where((y == 0) & (p > 0.8) & ~worst, 1, y)
    theta, step = fit(x, y, weight, begin, length, first)
    p = forward_backward(np.clip(x @ theta, -30, 30), step, *whole)[0][:, 1]
    total = np.bincount(of, weights=n)
    f = score_features(np.bincount(of, weights=p * n) / total, np.minimum.reduceat(p, whole[0]), total)
    natural = np.where(doc_y == 1, counts[1] / have[1], counts[0] / have[0]) * len(full) / sum(counts.values())
    return theta, step, fit_logistic(f, doc_y.astype(float), natural)


SCHEMA = "doc_id long, score double, goodness double, n_words long, n_lines long"


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of every text, and its weighted share of good lines."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, step, beta = sent.value
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1), 1 << 20):
                good, low, total, lines = goodness(text, starts, theta, step)
                p = 1 / (1 + np.exp(-np.clip(score_features(good, low, total) @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array(good), pa.array(total.astype(np.int64)), pa.array(lines.astype(np.int64))], names=["doc_id", "score", "goodness", "n_words", "n_lines"])

    return frames.arrow(docs.select(F.col(id_column).cast("long"), text_column), run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, fold: int = 5, rest: int = 0, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted, goodness, n_words, n_lines`` of every
    document.  Labels of ids with crc32 mod ``fold`` equal to ``rest`` are held out."""
    model = train(docs, labels, ~frames.held_out(F.col("id"), fold, rest), **bounds)
    out = score(docs, model)
    return out.select("doc_id", frames.held_out(F.col("doc_id"), fold, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "goodness", "n_words", "n_lines")


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 5, rest: int = 0, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", **bounds) -> DataFrame:
    """The rows with a score of at least ``threshold``, unchanged, in one pass."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(slim, labels, ~frames.held_out(F.col("id"), fold, rest), **bounds))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, step, beta = sent.value
        for b in batches:
            good = [np.zeros(0, bool)]
            for _, _, text, starts in kernel.blocks(b.column(at), 1 << 20):
                g, low, total, _ = goodness(text, starts, theta, step)
                good.append(1 / (1 + np.exp(-np.clip(score_features(g, low, total) @ beta, -30, 30))) >= threshold)
            yield b.filter(pa.array(np.concatenate(good)))

    return frames.arrow(docs, run, docs.schema)

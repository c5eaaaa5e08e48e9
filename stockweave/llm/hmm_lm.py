"""Language-model scoring by a hidden Markov model over words.

A word belongs to one class: each of the ``TOP`` most frequent training words is
a class of its own, the end of a text is one, and all others share ``SHAPES``
classes by their last letters and closing punctuation.  A state emits a class,
a class emits the word: the share of the word in its class's training tokens,
less a discount that is the share of words not seen in training.  So the
probability of a text is that of a hidden Markov model with an emission for
every word of the corpus, while its parameters number states times classes.

1. One pass over the texts makes chunks of up to ``CHUNK_TOKENS`` tokens: the
   documents as numbers of the chunk's words, and the chunk's words with their
   training counts.
2. Word counts are summed over chunks, exactly, over all training documents, and
   sent back: each chunk asks once for each of its words.  The few most frequent
   words don't take part in that join but are broadcast (``TOP`` rows).
3. Baum-Welch: each round, every task runs forward and backward over whole
   documents and emits expected counts (states times classes), which are summed
   over tasks as whole numbers of ``1 / _UNIT``, so their order doesn't matter.
   All training documents take part in all rounds.
4. The forward recursion over whole texts, scaled at each step, gives each
   text's exact likelihood.

Texts of more than ``LONG`` tokens are cut into segments, so that many of them are
run at once: the product of a segment's matrices carries the forward and backward
sums over its borders.  That is the uncut recursion in another order; no transition
is left out, in training or scoring.

Edge cases.  Null and empty texts are one end token.  A null id counts as
training.  Repeated rows count as often as they occur.  With no training
document all counts are 0 and classes are equally likely.  An empty table gives
none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernel

STATES = 8
TOP = 2048
SHAPES = 192
ROUNDS = 6
#: A chunk's words are numbered in three bytes, so it must stay below 2 ** 24.
CHUNK_TOKENS = 1_000_000
SEGMENT = 128
LONG = 1024
DISCOUNT = 0.5
#: Expected counts are summed in units of one part in so many.
_UNIT = 1 << 16
#: Tokens whose forward and backward sums are in memory at once.
_PART = 400_000
END = np.uint64(0xE0D)
_CHUNKS = "chunk long, row int, doc long, held boolean, codes binary, words array<long>, counts array<int>, shapes array<int>"
_FIELDS = [("chunk", pa.int64()), ("row", pa.int32()), ("doc", pa.int64()), ("held", pa.bool_()), ("codes", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("shapes", pa.list_(pa.int32()))]
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?")] = True


def shapes(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A class by the last three bytes before closing punctuation, and whether there is any."""
    closed = _PUNCTUATION[text[e - 1]]
    last = np.maximum(e - closed, s + 1)
    h = kernel.span_hash(text, np.maximum(last - 3, s), last)
    return (h % np.uint64(SHAPES // 2)).astype(np.int64) * 2 + closed


def pack(codes: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 in three bytes each."""
    if len(codes) and codes.max() >= 1 << 24:
        raise ValueError("a chunk has more than 2 ** 24 words")
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _chunks(docs: DataFrame, fold: int, rest: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        held_parts: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held_parts, number
            word = np.concatenate([p[0] for p in held_parts])
            shape = np.concatenate([p[1] for p in held_parts])
            n = np.concatenate([p[2] for p in held_parts])
            ids = pa.concat_arrays([p[3] for p in held_parts])
            held = np.concatenate([p[4] for p in held_parts])
            distinct, first, back, count = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            train = np.repeat(~held, n)
            seen = np.bincount(back[train], minlength=len(distinct))[order]
            codes = pack(rank[back])
            ends = np.cumsum(n).tolist()
            begin = 0
            out = []
            for e in ends:
                out.append(codes[3 * begin : 3 * e])
                begin = e
            k = len(ends)
            empty = pa.nulls(k)
            for a in range(0, k, 1000):
                b = min(k, a + 1000)
                yield frames.batch(_FIELDS, [np.full(b - a, base + number), np.arange(a, b), ids.slice(a, b - a), held[a:b], out[a:b], *[empty.slice(a, b - a).cast(t) for _, t in _FIELDS[5:]]])
            lists = [[distinct[order].view(np.int64)], [seen], [shape[first][order]]]
            yield frames.batch(_FIELDS, [[base + number], [None], [None], [None], [None], *[pa.array(x, t) for x, (_, t) in zip(lists, _FIELDS[5:])]])
            held_parts, number = [], number + 1

        size = 0
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                s, e = kernel.words(text)
                low = kernel.lower(text)
                _, offsets = kernel.per_text(starts, s)
                h = np.insert(kernel.span_hash(low, s, e), offsets[1:], END)
                shape = np.insert(shapes(low, s, e), offsets[1:], SHAPES)
                n = np.diff(offsets) + 1
                held_parts.append((h, shape, n, b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
                size += len(h)
                if size >= most:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    slim = docs.select("doc", "text", frames.held_out(F.col("doc"), fold, rest).alias("held"))
    return frames.arrow(slim, run, _CHUNKS)


class Words:
    """What the driver knows of the vocabulary: totals, the top words, the shapes."""

    def __init__(self, vocabulary: DataFrame, top: int):
        seen = vocabulary.filter("c > 0")
        own = np.zeros((SHAPES + 1, 2))  # the end token has the last shape to itself
        for r in seen.groupBy("shape").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            own[r["shape"]] = r.n, r.v
        self.tokens, self.types = (int(x) for x in own.sum(0))
        self.ends = int(own[SHAPES, 0])
        rows = seen.filter(F.col("shape") < SHAPES).orderBy(F.col("c").desc(), "word").limit(top).select("word", "c", "shape").collect()
        self.top = {r.word: (i, r.c) for i, r in enumerate(rows)}
        for r in rows:
            own[r["shape"]] -= r.c, 1
        self.shape_tokens, self.shape_types = own[:SHAPES, 0], own[:SHAPES, 1]
        self.n_top = len(rows)
        self.classes = self.n_top + SHAPES + 1
        if self.classes > 1 << 16:
            raise ValueError("classes are numbered in two bytes: top is too large")
        self.class_tokens = np.concatenate(([r.c for r in rows], self.shape_tokens, [self.ends])).astype(float)

    def log_share(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's share in its class."""
        shape = np.clip(cls - self.n_top, 0, SHAPES - 1)
        n, v = self.shape_tokens[shape], self.shape_types[shape]
        known = (c - DISCOUNT) / np.maximum(n, 1)
        unknown = (DISCOUNT * v + 1) / (n + 1)
        # One more token is thought of as unseen, so the shares still sum to one.
        known = known * n / (n + 1)
        share = np.where(c > 0, known, unknown)
        single = (cls < self.n_top) | (cls == self.classes - 1)
        return np.where(single, 0.0, np.log10(np.maximum(share, 1e-300)))


_SEQUENCES = "doc long, held boolean, n long, known long, base double, within double, classes binary"


def _sequences(chunks: DataFrame, words: Words, vocabulary: DataFrame) -> DataFrame:
    """Per document: its classes, and the parts of its scores that need counts."""
    spark = chunks.sparkSession
    asked = chunks.filter("words is not null").select("chunk", F.posexplode("words").alias("at", "word"))
    top = spark.createDataFrame([(w, c, i) for w, (i, c) in words.top.items()] + [(int(END), words.ends, words.classes - 1)], "word long, c long, cls int")
    mine = asked.join(F.broadcast(top.withColumnRenamed("word", "w")), F.col("word") == F.col("w"), "left")
    common = mine.filter("w is not null").select("chunk", "at", "c", "cls")
    others = vocabulary.select(F.col("word").alias("v"), F.col("c").alias("vc"), (F.col("shape") + words.n_top).cast("int").alias("vcls"))
    rare = mine.filter("w is null").select("chunk", "at", "word").join(others.hint("merge"), F.col("word") == F.col("v")).select("chunk", "at", F.col("vc").alias("c"), F.col("vcls").alias("cls"))
    answers = common.union(rare).select(F.col("chunk").alias("part"), "at", "c", "cls")
    texts = chunks.filter("words is null").select("chunk", "row", "doc", "held", "codes")

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        c, cls = np.zeros(len(at)), np.zeros(len(at), np.int64)
        c[at], cls[at] = right["c"].to_numpy(), right["cls"].to_numpy()
        plus, within = np.log10(c + 1), words.log_share(c, cls)
        codes = [unpack(x) for x in left["codes"].to_pylist()]
        n = np.array([len(x) for x in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        ends = np.cumsum(n)

        def total(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values[flat], ends - n) if len(n) else np.zeros(0)

        classes = cls[flat].astype("<u2")
        return pa.table({
            "doc": left["doc"], "held": left["held"], "n": pa.array(n), "known": pa.array(total((c > 0).astype(np.int64)).astype(np.int64)),
            "base": pa.array(total(plus).astype(float)), "within": pa.array(total(within).astype(float)),
            "classes": pa.array([classes[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())], pa.binary()),
        })

    frames.ship(spark)
    return texts.groupBy("chunk").cogroup(answers.groupBy("part")).applyInArrow(put, _SEQUENCES)


class Hmm:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, words: Words, states: int) -> Hmm:
        """Class frequencies, disturbed by fixed noise, and states that tend to stay."""
        noise = np.random.default_rng(20240101).normal(size=(states, words.classes))
        share = (words.class_tokens + 0.1) / (words.class_tokens + 0.1).sum()
        emit = share * np.exp(0.6 * noise)
        step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, words: Words, states: int) -> Hmm:
        start = counts[:states] + 0.1
        step = counts[states : states + states * states].reshape(states, states) + 0.1
        share = (words.class_tokens + 0.1) / (words.class_tokens + 0.1).sum()
        emit = counts[states + states * states :].reshape(states, -1) + 1.0 * share
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the runs, longest first; rows at each step; where each step begins."""
    order = np.argsort(-lengths, kind="stable")
    sorted_ = lengths[order]
    active = np.searchsorted(-sorted_, -np.arange(sorted_[0] if len(sorted_) else 0), "left")
    return order, active, np.concatenate(([0], np.cumsum(active)))


class Segments:
    """Sequences cut for running many at once: those of up to ``LONG`` tokens whole."""

    def __init__(self, lengths: np.ndarray, long: int | None = None, size: int = SEGMENT):
        long = LONG if long is None else long
        parts = np.where(lengths > long, -(-lengths // size), (lengths > 0).astype(np.int64))
        step = np.where(lengths > long, size, lengths)
        place = kernel.ragged(parts, np.zeros(len(parts)))
        self.owner = np.repeat(np.arange(len(lengths)), parts)
        self.begin = (np.cumsum(lengths) - lengths)[self.owner] + place * step[self.owner]
        self.length = np.minimum(step[self.owner], lengths[self.owner] - place * step[self.owner])
        self.starts = place == 0
        self.ends = place == parts[self.owner] - 1


def products(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, starts: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, the product of its matrices "move, then emit", scaled, and the
    log10 of the scale; a sequence's first token has no move before it."""
    k = len(model.start)
    order, active, _ = _by_time(length)
    at, emit = begin[order], np.ascontiguousarray(model.emit.T)
    m, logs = np.tile(np.eye(k), (len(order), 1, 1)), np.zeros(len(order))
    for t, n in enumerate(active):
        moved = (m[:n].reshape(-1, k) @ model.step).reshape(n, k, k)
        if not t:
            moved[starts[order]] = np.eye(k)
        moved *= emit[symbols[at[:n] + t]][:, None, :]
        s = moved.max((1, 2))
        m[:n] = moved / s[:, None, None]
        logs[:n] += np.log10(s)
    out, out_logs = np.empty_like(m), np.empty_like(logs)
    out[order], out_logs[order] = m, logs
    return out, out_logs


def borders(symbols: np.ndarray, cut: Segments, model: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums before each segment and backward sums after it, each up to a factor."""
    k = len(model.start)
    before, after = np.tile(model.start, (len(cut.begin), 1)), np.ones((len(cut.begin), k))
    some = np.flatnonzero(~(cut.starts & cut.ends))
    if not len(some):
        return before, after
    m, _ = products(symbols, cut.begin[some], cut.length[some], cut.starts[some], model)
    for j, i in enumerate(some.tolist()):
        if not cut.ends[i]:
            v = before[i] @ m[j]
            before[i + 1] = v / v.sum()
    for j, i in reversed(list(enumerate(some.tolist()))):
        if not cut.starts[i]:
            v = m[j] @ after[i]
            after[i - 1] = v / v.sum()
    return before, after


def expected_counts(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, starts: np.ndarray, before: np.ndarray, after: np.ndarray, model: Hmm) -> np.ndarray:
    """Expected counts of one Baum-Welch round over some segments, as one vector."""
    k = len(model.start)
    order, active, base = _by_time(length)
    begin, length, starts = begin[order], length[order], starts[order]
    before, after = before[order].astype(np.float32), after[order].astype(np.float32)
    at = np.concatenate([begin[:m] + t for t, m in enumerate(active)])
    sym = symbols[at]
    psi = model.emit.T.astype(np.float32)[sym]
    step = model.step.astype(np.float32)
    alpha, scale = np.empty_like(psi), np.empty(len(psi), np.float32)
    v = np.where(starts[:, None], before, before @ step)
    for t, m in enumerate(active):
        a, b = base[t], base[t] + m
        v = (v if not t else alpha[base[t - 1] : base[t - 1] + m] @ step) * psi[a:b]
        s = v.sum(1)
        np.maximum(s, 1e-30, out=s)
        v /= s[:, None]
        alpha[a:b], scale[a:b] = v, s
    beta = np.empty_like(psi)
    last = base[length - 1] + np.arange(len(length))
    beta[last] = after / np.maximum((alpha[last] * after).sum(1, keepdims=True), 1e-30)
    psi /= scale[:, None]
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        a, p = base[t], base[t - 1]
        beta[p : p + m] = (psi[a : a + m] * beta[a : a + m]) @ step.T
    w = psi * beta
    inner = np.flatnonzero(~starts)
    moves = (before[inner].T @ w[inner]).astype(float)
    for t in range(1, len(active)):
        m = active[t]
        moves += alpha[base[t - 1] : base[t - 1] + m].T @ w[base[t] : base[t] + m]
    gamma = alpha * beta
    emit = np.stack([np.bincount(sym, weights=gamma[:, j], minlength=model.emit.shape[1]) for j in range(k)])
    return np.concatenate((gamma[: active[0]][starts].sum(0), (moves * model.step).ravel(), emit.ravel()))


def counts_of(symbols: np.ndarray, lengths: np.ndarray, model: Hmm) -> np.ndarray:
    """Expected counts of whole sequences, some parts of them in memory at once."""
    cut = Segments(lengths)
    before, after = borders(symbols, cut, model)
    k = len(model.start)
    total = np.zeros(k + k * k + model.emit.size)
    part = (np.cumsum(cut.length) - cut.length) // _PART
    edges = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
    for lo, hi in zip(edges[:-1], edges[1:]):
        total += expected_counts(symbols, cut.begin[lo:hi], cut.length[lo:hi], cut.starts[lo:hi], before[lo:hi], after[lo:hi], model)
    return total


def likelihoods(symbols: np.ndarray, lengths: np.ndarray, model: Hmm) -> np.ndarray:
    """log10 of the probability of each whole sequence, by the forward recursion."""
    out = np.zeros(len(lengths))
    begin = np.cumsum(lengths) - lengths
    emit = np.ascontiguousarray(model.emit.T)
    short = np.flatnonzero((lengths <= LONG) & (lengths > 0))
    if len(short):
        order, active, _ = _by_time(lengths[short])
        at = begin[short][order]
        v = np.tile(model.start, (len(short), 1))
        total = np.zeros(len(short))
        for t, m in enumerate(active):
            v = (v[:m] @ model.step if t else v) * emit[symbols[at[:m] + t]]
            s = v.sum(1)
            v /= s[:, None]
            total[:m] += np.log10(s)
        out[short[order]] = total
    cut = Segments(lengths)
    some = np.flatnonzero(~(cut.starts & cut.ends))
    if len(some):
        m, logs = products(symbols, cut.begin[some], cut.length[some], cut.starts[some], model)
        for j, i in enumerate(some.tolist()):
            v = (model.start if cut.starts[i] else v) @ m[j]
            s = v.sum()
            out[cut.owner[i]] += np.log10(s) + logs[j]
            v = v / s
    return out


def _round(train: DataFrame, model: Hmm) -> np.ndarray | None:
    """Expected counts of all training documents; None if there are none."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = sent.value, None
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]
            if seqs:
                part = counts_of(np.concatenate(seqs).astype(np.int64), np.array([len(x) for x in seqs], np.int64), m)
                total = part if total is None else total + part
        if total is not None:
            units = np.rint(total * _UNIT).astype(np.int64)
            at = np.flatnonzero(units)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(units[at])], names=["at", "units"])

    sums = frames.arrow(train.select("classes"), run, "at int, units long").groupBy("at").agg(F.sum("units").alias("units")).toArrow()
    sent.unpersist()
    if not sums.num_rows:
        return None
    out = np.zeros(len(model.start) * (1 + len(model.start)) + model.emit.size)
    out[sums["at"].to_numpy()] = sums["units"].to_numpy() / _UNIT
    return out


def score_documents(docs: DataFrame, fold: int = 7, rest: int = 2, states: int = STATES, top: int = TOP, rounds: int = ROUNDS, chunk_tokens: int = CHUNK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score`` (add-one unigram) and ``score``, both log10 probabilities."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    chunks = frames.keep(_chunks(frames.fewer(slim), fold, rest, chunk_tokens))
    rows = chunks.filter("words is not null").select(F.explode(F.arrays_zip("words", "counts", "shapes")).alias("w"))
    vocabulary = frames.keep(rows.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("c"), F.min("w.shapes").alias("shape")))
    words = Words(vocabulary, top)
    frames.release(spark)
    sequences = frames.keep(_sequences(chunks, words, vocabulary))
    frames.drop(chunks, vocabulary)
    frames.release(spark)
    train = sequences.filter("not held")
    model = Hmm.first(words, states)
    for _ in range(rounds):
        counts = _round(train, model)
        if counts is None:
            break
        model = Hmm.from_counts(counts, words, states)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(6).to_pylist()]
            flat = np.concatenate(seqs).astype(np.int64) if seqs else np.zeros(0, np.int64)
            got = likelihoods(flat, np.array([len(x) for x in seqs], np.int64), m)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(got + b.column(5).to_numpy())], names=["doc", "held", "n", "known", "base", "score"])

    scored = frames.arrow(sequences, run, "doc long, held boolean, n long, known long, base double, score double")
    per_token = float(np.log10(words.tokens + words.types + 1))
    return scored.select(
        F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(per_token)).alias("base_score"), "score",
    )

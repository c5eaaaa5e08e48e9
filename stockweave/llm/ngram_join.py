"""N-gram Jaccard join: near duplicates by rare-first prefix filtering.

The set of a document is its distinct shingles of five words; two documents link
if their sets have a Jaccard similarity of 0.75 or more.  The steps:

1. One pass hashes the sets.  Equal sets form a class, stood for by its smallest
   id; only representatives are compared.  The same pass counts all shingles of
   all documents in ``2 ** SKETCH_BITS`` buckets, an array of fixed size.
2. Shingles are ordered by their bucket's count, rare first, then by hash.  Two
   similar sets share a shingle among the first ``n - ceil(0.75 n) + 1`` of each
   (prefix filter); only these are shuffled, once, by hash.
3. Documents that meet at a shingle give a pair unless their sizes (length
   filter) or their places in the prefixes (positional filter) exclude a link.
   Each pair is kept once.
4. The suffix filter compares small histograms of the sets, split by hash value:
   a lower bound of the difference.  What passes is verified once, on whole sets.
5. Links make components (alternating large and small stars).

Where more than ``SMALL`` documents meet, not all pairs are made: each document
is first paired with the first of the group and with a few neighbours.  When the
links so found have made components, only pairs *between* components are left to
look at, in blocks of ``BLOCK`` documents, so no task holds a group.  No pair is
dropped: every two documents that share a prefix shingle are either verified,
excluded by a filter, or known to be in one component.

Joins are told to shuffle: every side here grows with the input, so none may be
broadcast because it happens to be small.  Only the hot nodes of the links are
broadcast, which are no more than twice the square root of the number of links.

Copies take part once for each batch of rows they are read in, so a text that a
third of all rows repeat is no hot key.  Nothing but the sketch, of fixed size,
goes through the driver.

Edge cases.  Null and empty texts have an empty set and link with nothing; texts
of one to four words have one shingle, the whole.  A null id takes no part; its
component is null.  Repeated rows are copies.  An empty table gives none.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernel

SIZE = 5
SKETCH_BITS = 20
_CHUNKS = 64
SMALL = 64
BLOCK = 2048
_NEIGHBOURS = (1, 2, 4, 8, 16, 32)
_FACTS = "doc long, n long, k1 long, k2 long, chunk int, counts binary"
_FACT_FIELDS = [("doc", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]


def sets(text: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text of a block, ascending and distinct, and their number."""
    s, e = kernel.words(text)
    word = kernel.span_hash(kernel.lower(text), s, e)
    _, offsets = kernel.per_text(starts, s)
    n_words = np.diff(offsets)
    h = kernel.shingles(word, size)
    count = np.maximum(n_words - size + 1, 0)
    flat = h[kernel.ragged(count, offsets[:-1])] if len(h) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = kernel.run_hash(word, offsets[short], offsets[short + 1])
        flat = np.insert(flat, np.concatenate(([0], np.cumsum(count)))[short], whole)
        count[short] = 1
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(ends - count)[count > 0]] = True
    of = np.repeat(np.arange(len(count)), count)
    return flat[new], np.bincount(of[new], minlength=len(count))


def set_keys(flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    ends = np.cumsum(count)
    other = kernel.mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    return kernel.run_hash(flat, ends - count, ends).view(np.int64), kernel.run_hash(other, ends - count, ends).view(np.int64)


def _facts(docs: DataFrame, bits: int) -> DataFrame:
    """A row per document, and a few rows per task with its part of the sketch."""
    width = (1 << bits) // _CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                flat, n = sets(text, starts)
                counts += np.bincount((flat >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
                k1, k2 = set_keys(flat, n)
                none = pa.nulls(hi - lo)
                yield frames.batch(_FACT_FIELDS, [b.column(0).slice(lo, hi - lo), n, k1, k2, none.cast(pa.int32()), none.cast(pa.binary())])
        if counts.any():
            none = pa.nulls(_CHUNKS, pa.int64())
            parts = [counts[i * width : (i + 1) * width].astype(np.int64).tobytes() for i in range(_CHUNKS)]
            yield frames.batch(_FACT_FIELDS, [none, none, none, none, np.arange(_CHUNKS), parts])

    return frames.arrow(docs, run, _FACTS)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-3 * n // 4) + 1


_PREFIX = "h long, n int, k long, doc long, pos int"
_PREFIX_FIELDS = [("h", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())]


def _prefixes(docs: DataFrame, sketch, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sketch.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            parts, keys = [], []
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                flat, n = sets(text, starts)
                k1, k2 = set_keys(flat, n)
                keys += [(i, n[i - lo], k1[i - lo], k2[i - lo]) for i in range(lo, hi) if n[i - lo]]
                rare = frequency[(flat >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
                parts.append((lo, flat, n, rare, k1))
            best: dict[tuple, int] = {}  # of each set in this batch, the smallest id
            for i, *key in keys:
                key = tuple(key)
                if key not in best or ids[i] < ids[best[key]]:
                    best[key] = i
            chosen = set(best.values())
            for lo, flat, n, rare, k1 in parts:
                ends = np.cumsum(n)
                out = []
                for i in range(len(n)):
                    if lo + i not in chosen:
                        continue
                    a, c = ends[i] - n[i], prefix_length(n[i])
                    # Values ascend by hash, so a stable sort by count gives (count, hash).
                    order = np.argsort(rare[a : ends[i]], kind="stable")[:c]
                    out.append((flat[a + order], int(n[i]), k1[i], ids[lo + i], int(c)))
                if out:
                    length = [x[4] for x in out]
                    rep = [np.repeat([x[j] for x in out], length) for j in (1, 2, 3)]
                    yield frames.batch(_PREFIX_FIELDS, [np.concatenate([x[0] for x in out]).view(np.int64), *rep, kernel.ragged(length, np.zeros(len(out)))])

    return frames.arrow(docs, run, _PREFIX)


def may_link(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Length and positional filter, for sets that meet at these places."""
    needed = -(-3 * (na + nb) // 7)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= needed)


_MET = "a long, b long, h long, n int, pos int"
_MET_FIELDS = [("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]


def _meetings(prefixes: DataFrame, small: int) -> DataFrame:
    """Pairs ``(a, b)``; and for larger groups their members, ``b`` null."""

    def made(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        h, n, _, doc, pos = rows
        ok = may_link(n[i], pos[i], n[j], pos[j]) & (doc[i] != doc[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        low, high = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        pair = np.unique(np.stack((low, high), 1), axis=0)
        none = pa.nulls(len(pair))
        return frames.batch(_MET_FIELDS, [pair[:, 0], pair[:, 1], none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        large = None  # (hash, first row) of a large group that may go on

        def work(rows: list[np.ndarray], last: bool):
            """Results, and the rows of an unfinished group."""
            nonlocal large
            h, n, k, doc, pos = rows
            start = np.ones(len(h), bool)
            start[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(start)
            size = np.diff(np.concatenate((begin, [len(h)])))
            goes_on = np.zeros(len(begin), bool)
            held = len(h)
            if large is not None and h[0] == large[0]:
                goes_on[0] = True
            if not last and size[-1] <= small and not (len(begin) == 1 and goes_on[0]):
                held = begin[-1]
            of = np.repeat(np.arange(len(begin)), size)
            big = (size > small) | goes_on
            left = size[of] - (np.arange(len(h)) - begin[of])  # rows of the group from here on
            use = np.arange(len(h)) < held
            i = np.flatnonzero(use & ~big[of] & (left > 1))
            d = 1
            while len(i):
                i = i[left[i] > d]
                if (out := made(rows, i, i + d)) is not None:
                    yield out
                d += 1
            i = np.flatnonzero(use & big[of])
            if len(i):
                none = pa.nulls(len(i), pa.int64())
                yield frames.batch(_MET_FIELDS, [doc[i], none, h[i], n[i], pos[i]])
                for d in _NEIGHBOURS:
                    j = i[left[i] > d]
                    if len(j) and (out := made(rows, j, j + d)) is not None:
                        yield out
                first = begin[of[i]]
                if goes_on[0]:
                    more = [np.concatenate((c, [x])) for c, x in zip(rows, large[1])]
                    first = np.where(of[i] == 0, len(h), first)
                else:
                    more = rows
                if (out := made(more, i, first)) is not None:
                    yield out
            if held == len(h) and big[-1] and not (len(begin) == 1 and goes_on[0]):
                large = (h[-1], [c[begin[-1]] for c in rows])
            return [c[held:] for c in rows] if held < len(h) else None

        seen = None  # the last row's set at the last hash
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if not len(rows[0]):
                continue
            h, n, k = rows[:3]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (k[1:] != k[:-1])
            new[0] = seen != (h[0], n[0], k[0])
            seen = (h[-1], n[-1], k[-1])
            rows = [c[new] for c in rows]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            rest = yield from work([x.astype(np.int64) for x in rows], False)
        if rest is not None:
            yield from work(rest, True)

    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(n, "h").sortWithinPartitions("h", "n", "k", "doc")
    return frames.arrow(dealt, run, _MET)


def histogram(values: np.ndarray) -> bytes:
    """Number of values by their leading bits, about one each, at most 255."""
    bits = max(3, int(len(values)).bit_length())
    return np.minimum(np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of values in one set only."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    if (len(a) != len(b)) and max(a.max(), b.max()) == 255:
        return 0  # a count at its limit can't be added to another
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(1)
    return int(np.abs(a - b).sum())


def _candidate_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, text, starts in kernel.blocks(b.column(1)):
                flat, n = sets(text, starts)
                ends = np.cumsum(n).tolist()
                one = [flat[e - c : e] for e, c in zip(ends, n.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([histogram(x) for x in one], pa.binary()), pa.array([x.tobytes() for x in one], pa.binary())], names=["doc", "n", "parts", "members"])

    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    return frames.arrow(docs.join(wanted.hint("merge"), "doc", "left_semi"), run, "doc long, n long, parts binary, members binary")


def _similar(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link."""

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nb, x, y = (b.column(i).to_pylist() for i in range(6))
            ok = [p + q - 2 * -(-3 * (p + q) // 7) >= least_difference(np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)) for p, q, u, v in zip(na, nb, x, y)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for u, v in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= 75 * (len(both) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    def side(names: list[str], key: str) -> DataFrame:
        return kept.select(F.col("doc").alias(key), *[F.col(n).alias(f"{n}_{key}") for n in names]).hint("merge")

    near = pairs.join(side(["n", "parts"], "a"), "a").join(side(["n", "parts"], "b"), "b").select("a", "b", "n_a", "n_b", "parts_a", "parts_b")
    passed = frames.keep(frames.arrow(near, suffix, "a long, b long"))
    whole = passed.join(side(["members"], "a"), "a").join(side(["members"], "b"), "b").select("a", "b", "members_a", "members_b")
    return frames.keep(frames.arrow(whole, exact, "a long, b long"))


def _with_least(edges: DataFrame, low: DataFrame, hot: int) -> DataFrame:
    """``u, v, m``: each edge with its node's ``m``; ``low`` is ``u, m, size``.

    Nodes of more than ``hot`` edges, at most (edges / ``hot``), are broadcast.
    Their edges have ``m`` from there and are spread over the join of the others by
    a key of their own, whose matches are ignored."""
    hubs = low.filter(F.col("size") > hot).select("u", F.col("m").alias("hub"))
    key = F.when(F.col("hub").isNull(), F.col("u")).otherwise(F.xxhash64("v"))
    known = edges.join(F.broadcast(hubs), "u", "left").withColumn("k", key)
    cold = low.filter(F.col("size") <= hot).select(F.col("u").alias("k"), "m")
    return known.join(cold.hint("merge"), "k", "left").select("u", "v", F.coalesce("hub", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node with a link; the component is its
    smallest node.  Alternates large and small stars until nothing changes; each
    round is cut off in the shared folder.

    A node is hot from the square root of the number of edges on: at most twice
    that root are hot, and no task gets more than that root of one node's edges."""
    edges = frames.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, n = None, edges.count()
    for _ in range(rounds):
        hot = math.isqrt(n)
        size = F.count(F.lit(1)).alias("size")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), size)
        large = _with_least(both.filter("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), size)
        before = edges
        edges = frames.keep(_with_least(large, low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        frames.drop(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) >> 20"))).first())
        if now == state or not now[0]:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _between(members: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Pairs of large groups that link no component yet: block against block."""
    own = members.join(labels.hint("merge"), members["a"] == labels["node"], "left").select("h", F.col("a").alias("doc"), "n", "pos", F.coalesce("component", "a").alias("label"))
    mixed = own.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    own = own.join(mixed.hint("merge"), "h", "left_semi")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            h = b.column(0).to_numpy()
            if not len(h):
                continue
            start = np.ones(len(h), bool)
            start[1:] = h[1:] != h[:-1]
            at = np.arange(len(h))
            rank = at - np.maximum.accumulate(np.where(start, at, 0))
            if last == h[0]:
                rank[: np.flatnonzero(start)[1] if start.sum() > 1 else len(h)] += count
            last, count = h[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(rank // block, pa.int32())], names=["h", "doc", "n", "pos", "label", "block"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frames.keep(frames.arrow(own.repartition(n, "h").sortWithinPartitions("h", "n", "doc"), number, "h long, doc long, n int, pos int, label long, block int"))
    top = rows.groupBy("h").agg(F.max("block").alias("top"))
    dealt = rows.join(top.hint("merge"), "h").withColumn("other", F.explode(F.sequence(F.lit(0), "top")))
    dealt = dealt.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc", "n", "pos", "label", "block")

    def pairs(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        n, pos, doc, label, at = (table[c].to_numpy().astype(np.int64) for c in ("n", "pos", "doc", "label", "block"))
        left, right = np.flatnonzero(at == x), np.flatnonzero(at == y)
        out = []
        for i in left:
            j = right[(right > i) if x == y else slice(None)]
            ok = (label[j] != label[i]) & may_link(n[i], pos[i], n[j], pos[j])
            out.append(np.stack((np.minimum(doc[i], doc[j[ok]]), np.maximum(doc[i], doc[j[ok]])), 1))
        pair = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return dealt.groupBy("h", "x", "y").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = SKETCH_BITS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` and
    ``class_id`` (the smallest id with an equal set)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    facts = frames.keep(_facts(slim, bits))
    sums = frames.tree_sum(facts.filter("chunk is not null"), "chunk", "counts", "<i8")
    width = (1 << bits) // _CHUNKS
    total = np.concatenate([sums.get(i, np.zeros(width, np.int64)) for i in range(_CHUNKS)])
    sketch = spark.sparkContext.broadcast(np.minimum(total, 2**31 - 1).astype(np.int32))

    known = slim.filter("doc is not null")
    met = frames.keep(_meetings(_prefixes(known, sketch, bits), small))
    frames.release(spark)
    pairs = frames.keep(met.filter("b is not null").select("a", "b").distinct())
    kept = frames.keep(_candidate_sets(known, pairs))
    frames.release(spark)
    links = _similar(kept, pairs)
    frames.drop(kept)
    labels = components(links)
    members = met.filter("b is null").select("a", "h", "n", "pos")
    if members.take(1):
        labels = frames.keep(labels)
        more = frames.keep(_between(members, labels, block).join(pairs, ["a", "b"], "left_anti"))
        if more.take(1):
            frames.release(spark)
            more_links = _similar(frames.keep(_candidate_sets(known, more)), more)
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more_links))

    rows = facts.filter("chunk is null").select("doc", "n", "k1", "k2")
    classes = rows.filter("doc is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # A class of a third of all rows would make one task of this join: salt it.
    salted = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("doc"), F.lit(16)).cast("int"))
    on = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("mine") == F.col("salt")) & (F.col("n") > 0) & F.col("doc").isNotNull()
    with_class = mine.join(salted.hint("merge"), on, "left").select("doc", "n", F.coalesce("rep", "doc").alias("class"))
    hot = labels.select("node", "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    mine = with_class.withColumn("mine", F.pmod(F.xxhash64("doc"), F.lit(16)).cast("int"))
    joined = mine.join(hot.hint("merge"), (F.col("class") == F.col("node")) & (F.col("mine") == F.col("salt")), "left")
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"), F.col("class").alias("class_id"))

"""Line dedup: overlapping windows of three consecutive lines.

A line is a ``\\n``-line with a word, however long.  Windows of ``window`` consecutive
lines are hashed (words in lower case, white space ignored).  Of all places with one
64-bit hash, the first by document id and position stays; the lines of the others are
covered, and all covered lines are removed, a whole ``\\n``-line with its line break.
Nothing else of a text changes.

Beside these windows, long lines are searched inside.  A line of more than ``longest``
words is wrapped: of every ``_AMONG`` consecutive pairs of words in it, the one with
the least hash ends a piece (winnowing).  Such ends depend on nothing but the words
around, so a passage inside long lines breaks alike wherever it stands, but for
``_AMONG - 1`` pairs of words at each side.  Windows of pieces (and whole short lines
among them) run on until they have ``window`` of them and ``least_words`` words, since
pieces may be as short as a word.  A piece is no longer than ``_AMONG`` words inside
such a passage, so a repeated passage of more than 50 words always has a window, of
which up to 15 words at each side can stay.

Scale.  A task combines before the shuffle: of the places of a window in a
batch, the first goes on, the others are known to be later.  So a window of a
third of all documents is one row per batch in the shuffle.  The reducer reads
its rows in order and keeps one row in memory.  A document's places are gathered
once each, however often its row repeats, and its text is joined once, by id.

Edge cases.  Null texts stay null, texts without a word stay as they are.  Rows
of one id and one text are one document and are treated alike; rows of one id
with other texts don't mix, since a place carries its window's hash.  Rows with a
null id come first, each text of them a document of its own.  Other columns pass
through, whatever their names.  ``n_lines`` and ``n_removed_lines`` count pieces of
long lines as lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames, kernel

WINDOW = 3
LONGEST = 16
LEAST_WORDS = 20
_AMONG = 8
#: Sets hashes of windows of pieces apart from those of lines.
_PIECES = np.uint64(0x9E6C63D0876A9A47)
#: ``code`` is the line's number times 4, plus 2 for a document with an id, plus 1
#: for a place that is known to be a later one.
_PLACES = "window long, doc long, code long"
_FIELDS = [("window", pa.int64()), ("doc", pa.int64()), ("code", pa.int64())]


class Lines:
    """The lines of a block: word ranges, the text they are in, their hashes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, longest: int = LONGEST):
        self.text, self.starts = text, starts
        s, e = kernel.words(text)
        word = kernel.span_hash(kernel.lower(text), s, e)
        of = np.searchsorted(starts, s, "right") - 1
        breaks = np.concatenate(([0], np.cumsum(text == 10)))
        in_line = breaks[s]  # number of the word's \n-line
        first = np.ones(len(s), bool)
        first[1:] = in_line[1:] != in_line[:-1]
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate((begin, [len(s)])))
        cut = first.copy()
        if len(s) > _AMONG:
            pair = kernel.mix(word[:-1] * np.uint64(3) + word[1:])
            # All words must be of one line, else what stands before a text would matter.
            inside = (in_line[:-_AMONG] == in_line[_AMONG:]) & (np.repeat(size, size)[:-_AMONG] > longest)
            least = pair[: len(inside)].copy()
            for k in range(1, _AMONG):
                np.minimum(least, pair[k : k + len(inside)], out=least)
            wrap = np.zeros(len(pair), bool)
            for k in range(_AMONG):
                wrap[k : k + len(inside)] |= inside & (pair[k : k + len(inside)] == least)
            cut[2:] |= wrap[:-1]  # a new line begins after the pair
        self.first = np.flatnonzero(cut)
        self.last = np.concatenate((self.first[1:], [len(s)])).astype(np.int64) if len(self.first) else self.first
        self.of = of[self.first]
        self.begins = first[self.first]
        self.whole = self.begins & (np.concatenate((first[1:], [True]))[self.last - 1] if len(s) else np.zeros(0, bool))
        self.hash = kernel.run_hash(word, self.first, self.last)
        self.words = self.last - self.first
        # The same for the whole \n-lines: their first pieces and words.
        self.line_at = np.flatnonzero(self.begins)
        line_end = np.concatenate((begin[1:], [len(s)])).astype(np.int64) if len(begin) else begin
        self.line_hash = kernel.run_hash(word, begin, line_end)
        self.s, self.e, self.line = s, e, in_line

    def windows(self, size: int, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the first piece, number of pieces and hash of each window, of whole lines first."""
        found = [self._whole(size), self._wrapped(size, least_words)]
        at, n, h = (np.concatenate(x) for x in zip(*found))
        return at, n, h

    def _whole(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of so many whole ``\\n``-lines."""
        n = len(self.line_at) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kernel.U)
        k = np.arange(n)
        k = k[self.of[self.line_at[k]] == self.of[self.line_at[k + size - 1]]]
        after = np.concatenate((self.line_at[1:], [len(self.hash)]))
        return self.line_at[k], after[k + size - 1] - self.line_at[k], kernel.run_hash(self.line_hash, k, k + size)

    def _wrapped(self, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of consecutive pieces, one of them at least not a whole line."""
        n = len(self.hash)
        at = np.arange(max(n - size + 1, 0))
        before = np.concatenate(([0], np.cumsum(self.words)))
        pieces = np.concatenate(([0], np.cumsum(~self.whole)))
        end = np.maximum(np.searchsorted(before, before[at] + least_words), at + size)
        ok = (end <= n) & (pieces[np.minimum(end, n)] > pieces[at])
        at, end = at[ok], end[ok]
        ok = self.of[end - 1] == self.of[at] if len(at) else ok[:0]
        at, end = at[ok], end[ok]
        return at, end - at, kernel.run_hash(self.hash, at, end) ^ _PIECES

    def offsets(self) -> np.ndarray:
        return np.searchsorted(self.of, np.arange(len(self.starts)))


def _identity(id_column: str, text_column: str) -> list[Column]:
    """Whether a document has an id, and the id, or a hash of the text."""
    number = F.col(id_column).cast("long")
    return [number.isNotNull(), F.coalesce(number, F.xxhash64(text_column))]


def _places(docs: DataFrame, id_column: str, text_column: str, window: int, longest: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, at, h = [], [], []
            for lo, hi, text, starts in kernel.blocks(b.column(2)):
                lines = Lines(text, starts, longest)
                where, _, hashes = lines.windows(window, least_words)
                of = lines.of[where]
                row.append(lo + of)
                at.append(where - lines.offsets()[of])
                h.append(hashes)
            if not row:
                continue
            row, at, h = np.concatenate(row), np.concatenate(at), np.concatenate(h)
            doc, known = ids[row], named[row]
            order = np.lexsort((at, doc, known, h))
            doc, known, at, h = doc[order], known[order], at[order], h[order]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (known[1:] != known[:-1]) | (at[1:] != at[:-1]))
            yield frames.batch(_FIELDS, [h.view(np.int64), doc, 4 * at + 2 * known + same])

    return frames.arrow(docs.select(*_identity(id_column, text_column), F.col(text_column).alias("text")), run, _PLACES)


def later_places(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, longest: int = LONGEST, least_words: int = LEAST_WORDS) -> DataFrame:
    """Places of repeated windows but the first: ``named, doc, at, window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # window and place of the first row of the last run
        for b in batches:
            h, doc, code = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(h):
                continue
            known, place = code % 2 == 1, code >> 1
            start = np.ones(len(h), bool)
            start[1:] = (h[1:] != h[:-1]) | (known[1:] != known[:-1])
            run_of = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
            first_doc, first_place = doc[run_of], place[run_of]
            if head is not None and not known[0] and head[0] == h[0]:
                first_doc[run_of == 0], first_place[run_of == 0] = head[1], head[2]
            later = known | (doc != first_doc) | (place != first_place)
            if not known[-1]:
                head = (h[-1], first_doc[-1], first_place[-1])
            place = place[later]
            yield pa.RecordBatch.from_arrays([pa.array(place % 2 == 1), pa.array(doc[later]), pa.array((place >> 1).astype(np.int32)), pa.array(h[later])], names=["named", "doc", "at", "window"])

    places = _places(docs, id_column, text_column, window, longest, least_words)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    later, named = F.col("code").bitwiseAND(F.lit(1)), F.col("code").bitwiseAND(F.lit(2))
    dealt = places.repartition(n, F.when(later == 1, F.xxhash64("doc")).otherwise(F.col("window")))
    return frames.arrow(dealt.sortWithinPartitions(later, "window", named, "doc", "code"), run, "named boolean, doc long, at int, window long")


def covered_lines(lo: int, hi: int, places: np.ndarray, hashes: np.ndarray, windows: dict) -> np.ndarray:
    """Of the pieces ``lo`` to ``hi - 1`` those that are in a window at one of the places."""
    edge = np.zeros(hi - lo + 1, np.int64)
    for at, h in zip(places.tolist(), hashes.tolist()):
        size = windows.get((lo + at, h))
        if size is not None and at + size <= hi - lo:
            edge[at] += 1
            edge[at + size] -= 1
    return lo + np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def without(lines: Lines, i: int, gone: np.ndarray) -> str:
    """Text ``i`` of the block without some of its lines.

    A ``\\n``-line of which all is gone goes with its line break; a piece goes from
    its first word to the next piece's, or to the line's last word."""
    begin, end = int(lines.starts[i]), int(lines.starts[i + 1]) - 1
    keep = np.ones(end - begin, bool)
    out = set(gone.tolist())
    breaks = np.flatnonzero(lines.text[begin:end] == 10)
    for u in gone.tolist():
        first, after = lines.first[u], lines.last[u]
        same = after < len(lines.s) and lines.line[after] == lines.line[after - 1] and lines.s[after] < end
        keep[lines.s[first] - begin : (lines.s[after] if same else lines.e[after - 1]) - begin] = False
        if lines.begins[u]:
            v = u
            while v in out and v + 1 < len(lines.first) and not lines.begins[v + 1]:
                v += 1
            if v in out:
                k = int(np.searchsorted(breaks, lines.s[first] - begin))
                keep[(breaks[k - 1] + 1 if k else 0) : (breaks[k] + 1 if k < len(breaks) else end - begin)] = False
    return lines.text[begin:end][keep].tobytes().decode("utf-8", "replace")


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, longest: int = LONGEST, least_words: int = LEAST_WORDS, counts: tuple[str, str, str] = ("n_lines", "n_removed_lines", "n_removed_words")
) -> DataFrame:
    """The rows with later occurrences removed from the text, and three counts.

    A count whose name is a column already replaces that column."""
    docs = docs.drop(*counts)
    places = later_places(docs, id_column, text_column, window, longest, least_words)
    # The frames' own names, none of them a column of the documents.
    of, named, doc = (frames.fresh(docs, x) for x in ("places", "named", "doc"))
    listed = places.groupBy(F.col("named").alias(named), F.col("doc").alias(doc)).agg(F.collect_set(F.struct("at", "window")).alias(of))
    has_id, number = _identity(id_column, text_column)
    joined = docs.join(listed, (has_id == F.col(named)) & (number == F.col(doc)), "left")
    joined = joined.select(*docs.columns, F.col(f"{of}.at").alias(named), F.col(f"{of}.window").alias(doc))
    text_at, n, names = docs.columns.index(text_column), len(docs.columns), [*docs.columns, *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, h = b.column(n), b.column(n + 1)
            at_off, at_flat = np.asarray(at.offsets), np.asarray(at.values)
            h_flat = np.asarray(h.values)
            valid = np.asarray(at.is_valid())
            out = b.column(text_at).to_pylist() if valid.any() else None
            total, removed, removed_words = [], [], []
            for lo, hi, text, starts in kernel.blocks(b.column(text_at)):
                lines = Lines(text, starts, longest)
                offsets = lines.offsets()
                total.append(np.diff(offsets))
                r, w = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                if valid[lo:hi].any():
                    first, size, hashes = lines.windows(window, least_words)
                    windows = dict(zip(zip(first.tolist(), hashes.view(np.int64).tolist()), size.tolist()))
                    for i in np.flatnonzero(valid[lo:hi]).tolist():
                        p = slice(at_off[lo + i], at_off[lo + i + 1])
                        gone = covered_lines(offsets[i], offsets[i + 1], at_flat[p], h_flat[p], windows)
                        if len(gone):
                            r[i], w[i] = len(gone), lines.words[gone].sum()
                            out[lo + i] = without(lines, i, gone)
                removed.append(r)
                removed_words.append(w)
            columns = [b.column(k) for k in range(n)]
            if out is not None:
                columns[text_at] = pa.array(out, b.schema.field(text_at).type)
            columns += [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (total, removed, removed_words)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return frames.arrow(joined, run, schema)

"""Fill-in-middle transformation by a table-driven automaton over bytes.

A text's units are ``[A-Za-z]+|[^A-Za-z]``, matched left to right over code points.
Two cuts fall between units and part a text into prefix, middle and suffix, which
are put out with the middle last, behind sentinels: ``psm`` is ``<P>`` prefix
``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
``plain`` is the text as it is.

First pass.  An automaton reads every byte once and puts out the number of the
transition it takes.  Its states tell what the last bytes were: a letter, ``<``, the
letter of a sentinel, or a character of which one to three bytes are still due.  A
transition says by itself whether a unit, a character or nothing begins there, and
whether a sentinel is complete, so counting transitions gives a text's units and
characters and whether it holds a sentinel.

The state depends on the last ``MEMORY`` bytes alone; that number is computed from the
table.  So a block of bytes is cut into lanes, each lane starts so many bytes
early in any state, and all lanes take a step at once; how long a text is makes no
difference.

Second pass.  The cuts, drawn as numbers of units, are looked up among the places of
the transitions that begin a unit.

Where the cuts fall depends on the seed and the document's id alone, not on
partitions or order.  A document with a sentinel stays plain, so outputs can be undone:
:func:`restore` gives the exact text back.

Edge cases.  A null text is an empty one, which is plain; its output is empty.  A null
id is drawn as an empty string.  Repeated rows have the same result each.  Texts of any
length are read whole.  Columns other than the text pass through whatever their
names, but for those named like a new column, which are replaced.  An empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames, kernel

OTHER, LETTER, OPEN, NAMED, DUE1, DUE2, DUE3 = STATES = range(7)
_NAME, _LETTER, _OPEN, _CLOSE, _ASCII, _LEAD2, _LEAD3, _LEAD4, _FOLLOW = KINDS = range(9)
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Steps that a lane takes after those it starts early.
STEPS = 64


def _kind(byte: int) -> int:
    if byte >= 0x80:
        return _FOLLOW if byte < 0xC0 else _LEAD2 if byte < 0xE0 else _LEAD3 if byte < 0xF0 else _LEAD4
    if chr(byte).isalpha():
        return _NAME if chr(byte) in "PSM" else _LETTER
    return {"<": _OPEN, ">": _CLOSE}.get(chr(byte), _ASCII)


def _next(state: int, kind: int) -> int:
    if kind in (_NAME, _LETTER):
        return NAMED if (state, kind) == (OPEN, _NAME) else LETTER
    if kind == _FOLLOW:
        return {DUE3: DUE2, DUE2: DUE1}.get(state, OTHER)
    return {_OPEN: OPEN, _LEAD2: DUE1, _LEAD3: DUE2, _LEAD4: DUE3}.get(kind, OTHER)


def _table(rule, kind=np.uint8) -> np.ndarray:
    """A value of each transition, by its number: the state times the number of kinds, plus the kind."""
    return np.array([rule(s, k) for s in STATES for k in KINDS], kind)


_KIND_OF = np.array([_kind(b) for b in range(256)], np.uint8)
_NEXT = _table(lambda s, k: len(KINDS) * _next(s, k))
_UNIT = _table(lambda s, k: s not in (LETTER, NAMED) if k in (_NAME, _LETTER) else k != _FOLLOW, bool)
_CHARACTER = _table(lambda s, k: k != _FOLLOW, bool)
_SENTINEL = _table(lambda s, k: (s, k) == (NAMED, _CLOSE), bool)


def _memory() -> int:
    """After so many bytes the state doesn't depend on the one before them."""
    sets, n = {frozenset(STATES)}, 0
    while any(len(s) > 1 for s in sets):
        sets, n = {frozenset(_next(x, k) for x in s) for s in sets for k in KINDS}, n + 1
    return n


MEMORY = _memory()


def transitions(text: np.ndarray) -> np.ndarray:
    """The number of the transition that each byte takes."""
    n = len(text)
    lanes = max(1, -(-n // STEPS))
    kinds = np.full(MEMORY + lanes * STEPS, _ASCII, np.uint8)
    kinds[MEMORY : MEMORY + n] = _KIND_OF[text]
    steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(kinds, MEMORY + STEPS)[::STEPS].T)
    state, taken = np.zeros(lanes, np.uint8), np.empty((MEMORY + STEPS, lanes), np.uint8)
    for kind, out in zip(steps, taken):
        np.add(state, kind, out=out)
        state = _NEXT[out]
    return taken[MEMORY:].T.reshape(-1)[:n]


class Scan:
    """What the first pass found in a block of texts, one line break behind each."""

    def __init__(self, text: np.ndarray, starts: np.ndarray):
        taken = transitions(text)
        self.first, self.end = starts[:-1], starts[1:] - 1
        self.unit, self.character = np.flatnonzero(_UNIT[taken]), np.flatnonzero(_CHARACTER[taken])
        self.before = np.searchsorted(self.unit, self.first)
        self.units = np.searchsorted(self.unit, self.end) - self.before
        sentinel = np.flatnonzero(_SENTINEL[taken])
        self.marked = np.searchsorted(sentinel, self.end) > np.searchsorted(sentinel, self.first)

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The second pass: where so many units of each text end."""
        at = np.where(units < self.units, self.before + units, 0)
        return np.where(units < self.units, self.unit[at], self.end) if len(self.unit) else self.end

    def characters(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.character, end) - np.searchsorted(self.character, begin)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, names: tuple[str, str, str, str] = ("n", "form", "prefix_chars", "middle_chars")) -> DataFrame:
    """The rows with the output in place of the text, the number of units, the form and
    the characters of prefix and middle (null if plain).

    Of 100 drawn numbers, those from ``plain_from`` on leave a text plain; of 100 others
    those below ``spm_below`` give spm."""
    docs = docs.select([c for c in docs.columns if c.lower() not in names])
    drawn = [F.col(c) for c in docs.columns] + [h.alias(frames.fresh(docs, f"h{i}")) for i, h in enumerate(draws(F.col(id_column), seed))]
    text_at, width, fields = docs.columns.index(text_column), len(docs.columns), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [b.column(width + i).to_numpy() for i in range(4)]
            outputs, forms, sizes = [], [], []
            for lo, hi, text, starts in kernel.blocks(b.column(text_at)):
                scan = Scan(text, starts)
                one, two = (x[lo:hi] % (scan.units + 1) for x in h[:2])
                a, z = scan.cuts(np.minimum(one, two)), scan.cuts(np.maximum(one, two))
                plain = (scan.units == 0) | scan.marked | (h[2][lo:hi] % 100 >= plain_from)
                spm = h[3][lo:hi] % 100 < spm_below
                sizes.append([scan.units, np.where(plain, -1, scan.characters(scan.first, a)), np.where(plain, -1, scan.characters(a, z))])
                whole = text.tobytes()
                for i, j, k, m, is_plain, is_spm in zip(scan.first.tolist(), a.tolist(), z.tolist(), scan.end.tolist(), plain.tolist(), spm.tolist()):
                    if is_plain:
                        outputs.append(whole[i:m])
                    elif is_spm:
                        outputs.append(b"".join((SUFFIX, whole[k:m], PREFIX, whole[i:j], MIDDLE, whole[j:k])))
                    else:
                        outputs.append(b"".join((PREFIX, whole[i:j], SUFFIX, whole[k:m], MIDDLE, whole[j:k])))
                forms += np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist()
            n, prefix, middle = (np.concatenate(x) for x in zip(*sizes)) if sizes else (np.zeros(0, np.int64),) * 3
            columns = [b.column(i) for i in range(width)]
            columns[text_at] = pa.array(outputs, pa.binary()).cast(b.schema.field(text_at).type)
            columns += [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *[pa.array(x, pa.int64(), mask=x < 0) for x in (prefix, middle)]]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    return frames.arrow(docs.select(drawn), run, T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form."""
    before = lambda mark: F.substring_index(output, mark.decode(), 1)
    between = lambda mark: F.substring_index(before(MIDDLE), mark.decode(), -1)
    head = lambda mark: F.substr(before(mark), F.lit(len(mark) + 1))
    middle = F.substring_index(output, MIDDLE.decode(), -1)
    psm = F.concat(head(SUFFIX), middle, between(SUFFIX))
    spm = F.concat(between(PREFIX), middle, head(PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(done: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Hashes of outputs and of the texts restored from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        id_column, "n", "form", "prefix_chars", "middle_chars",
        sha(F.col(text_column)).alias("output_sha256"), sha(restore(F.col(text_column), F.col("form"))).alias("restored_sha256"),
    )

"""Packing: hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the longest size and a tail.  A tail is
routed to the shortest tier that holds it, and each tier packs its own, the longest
first.  Of every tier but the longest, one tail in ``FILLER`` is set aside to fill the
gaps of longer tiers: the longest that fits a gap goes in whole, what is then open is
filled by a cut, from the shortest set aside, or else from the tier's own shortest.
What is set aside and not used is packed in its own tier.  What is left when a block
of documents is used up goes on to the next block, so a task ends with at most one
padded sequence for all it has read.  Sequences are dealt to step groups of about
equal attention cost (the sum of squared lengths), the costliest first; a group's
cost is the same in all tasks, that of a step full of the longest sequences.

Memory: one block of documents and the carried rest, whatever the input.  There
is no shuffle: each task packs its own split, and a lost task is packed again to
the same sequences, since a split's rows and their order don't change.

Edge cases.  Null and empty texts are one end token.  A null id stays null.
Repeated rows are packed like any other rows.  An empty table gives none.  A
document longer than a window is cut, never dropped.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import frames, kernel, tokens

TIERS = (128, 256, 512, 1024)
BLOCK = 1 << 20
FILLER = 2
#: Tokens of a step group of the longest sequences.
STEP_TOKENS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int, padded_to int, step_id long"
_FIELDS = [(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in SCHEMA.split(", ")]


class Packer:
    """Packs pieces ``(row, start, ids)`` to sequences, block by block."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.size = self.tiers[-1]
        self.rest: list[tuple] = []

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def pack(self, pieces: list[tuple], last: bool) -> list[tuple[int, list[tuple]]]:
        """Sequences ``(tier, pieces)``; unless ``last``, a rest is carried on."""
        full: list[tuple[int, list[tuple]]] = []
        queue: dict[int, list[tuple]] = {t: [] for t in self.tiers}  # (length, piece), longest last
        tier = [self.tier(n) for n in range(self.size + 1)]
        length = itemgetter(0)
        for row, start, ids in [*self.rest, *pieces]:
            n = len(ids)
            whole = n // self.size * self.size
            full += [(self.size, [(row, start + k, ids[k : k + self.size])]) for k in range(0, whole, self.size)]
            if whole < n:
                queue[tier[n - whole]].append((n - whole, row, start + whole, ids[whole:] if whole else ids))
        self.rest = []
        for t in self.tiers:
            queue[t].sort(key=length)
        for t in reversed(self.tiers):
            aside: list[tuple] = []
            for u in self.tiers:
                if u < t:  # tiers ascend, so what is set aside does too
                    aside += queue[u][::FILLER]
                    queue[u] = [p for k, p in enumerate(queue[u]) if k % FILLER]
            sizes = [p[0] for p in aside]
            own = deque(queue[t])
            while own:
                n, *piece = own.pop()
                here, gap = [tuple(piece)], t - n
                while gap and (sizes or own):
                    k = bisect_right(sizes, gap) - 1
                    if k >= 0:
                        del sizes[k]
                        n, row, start, ids = aside.pop(k)
                    elif sizes:
                        del sizes[0]
                        n, row, start, ids = aside.pop(0)
                        at = bisect_right(sizes, n - gap)
                        sizes.insert(at, n - gap)
                        aside.insert(at, (n - gap, row, start + gap, ids[gap:]))
                        n, ids = gap, ids[:gap]
                    else:
                        n, row, start, ids = own.popleft()
                        if n > gap:
                            own.appendleft((n - gap, row, start + gap, ids[gap:]))
                            n, ids = gap, ids[:gap]
                    here.append((row, start, ids))
                    gap -= n
                if gap:
                    self.rest += here
                else:
                    full.append((t, here))
            for p in aside:
                queue[tier[p[0]]].append(p)
            for u in self.tiers:
                if u < t:
                    queue[u].sort(key=length)
        if last and self.rest:
            pieces, self.rest = self.rest, []
            full += self._split(pieces, sum(len(p[2]) for p in pieces))
        return full

    def _split(self, pieces: list[tuple], left: int) -> list[tuple[int, list[tuple]]]:
        """Fill shorter tiers with a rest; what is below the shortest is padded."""
        out = []
        for size in reversed(self.tiers):
            while left >= size:
                here, used = [], 0
                while used < size:
                    row, start, ids = pieces[0]
                    n = min(len(ids), size - used)
                    here.append((row, start, ids[:n]))
                    used += n
                    pieces = pieces[1:] if n == len(ids) else [(row, start + n, ids[n:]), *pieces[1:]]
                out.append((size, here))
                left -= size
        return out + ([(self.size, pieces)] if left else [])


def deal(lengths: list[int], step_tokens: int = STEP_TOKENS, longest: int = TIERS[-1]) -> list[int]:
    """Step group of each sequence: longest first, to the group of least cost.

    There are as many groups as make each cost what ``step_tokens`` tokens of the
    longest sequences do."""
    groups = [(0, g) for g in range(max(1, round(sum(n * n for n in lengths) / (step_tokens * longest))))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        cost, g = groups[0]
        heapq.heapreplace(groups, (cost + lengths[i] ** 2, g))
        out[i] = g
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece of a document; see ``SCHEMA``.

    ``offset`` is the piece's place in its sequence, ``start`` that in its
    document's ids, the end token ``end_id`` included.  ``padded_to`` is the
    tier of the sequence, or the longest size if its last part is padding.
    Sequences and step groups are numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.encoder(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        sequences = steps = 0

        def emit(made: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            nonlocal sequences, steps
            group = deal([size for size, _ in made], step_tokens, max(tiers))
            rows = []
            for (size, pieces), g in zip(made, group):
                used, at = sum(len(p[2]) for p in pieces), 0
                for (key, total), start, ids in pieces:
                    n = len(ids)
                    rows.append((key, start, n, zlib.crc32(ids), total, base + sequences, at, used, size, base + steps + g))
                    at += n
                sequences += 1
            steps += max(group, default=-1) + 1
            return frames.batch(_FIELDS, list(zip(*rows)))

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi, text, starts in kernel.blocks(b.column(1), BLOCK):
                ids, counts = encoder.encode_block(text, starts)
                cuts = np.cumsum(counts)
                ids = np.insert(ids, cuts, end_id).astype("<u4")
                ends = cuts + np.arange(1, hi - lo + 1)
                pieces = [((keys[lo + i], int(n) + 1), 0, ids[e - n - 1 : e]) for i, (n, e) in enumerate(zip(counts.tolist(), ends.tolist()))]
                made = packer.pack(pieces, False)
                packer.rest = [(row, start, x.copy()) for row, start, x in packer.rest]
                if made:
                    yield emit(made)
        made = packer.pack([], True)
        if made:
            yield emit(made)

    return frames.arrow(docs.select(id_column, text_column), run, SCHEMA)

"""Vectorised text kernels over UTF-8 byte buffers.

Arrow batches arrive as one byte buffer plus offsets.  The functions here split
such a buffer into words and lines and hash them with numpy, so that no Python
object is made for a word.  A word is ``[^\\x20\\x09-\\x0D]+``; those bytes never
occur inside a multi-byte UTF-8 character, so byte positions are safe to cut at.

Hashes are 64 bits wide.  They depend on nothing but the bytes, so every
executor and every retry computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once: small enough for the temporary arrays (8 bytes
#: for each byte of text) to stay in a core's cache.
BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, U(base))
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first, end, bytes, starts)`` for runs of whole texts.

    ``bytes`` holds the texts ``first`` to ``end - 1``, each followed by one line
    break so that words and lines never cross texts; ``starts`` has one more
    entry than there are texts.  A null text is an empty one.  A text longer
    than ``most`` gets a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        k, part = hi - lo, offsets[lo : hi + 1] - offsets[lo]
        starts = part + np.arange(k + 1)
        out = np.full(int(starts[-1]), 10, np.uint8)
        if k == 1:
            out[:-1] = data[offsets[lo] : offsets[hi]]
        else:
            keep = np.ones(len(out), bool)
            keep[starts[1:] - 1] = False
            out[keep] = data[offsets[lo] : offsets[hi]]
        yield lo, hi, out, starts
        lo = hi


def lower(text: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[text]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[0::2], edges[1::2]


def words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block."""
    return spans(~_SEPARATOR[text])


def span_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes: a polynomial read off prefix sums."""
    up, down = _power_tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, U)
    np.cumsum(_BYTE_VALUE[text] * up[: len(text)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def run_hash(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of consecutive item hashes."""
    up, down = _power_tables(len(items) + 1)
    sums = np.zeros(len(items) + 1, U)
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def shingles(items: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive items; empty if too few."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(size):
        out += items[k : k + n] * U(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix(out)


def per_text(starts: np.ndarray, span_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which text each span is in, and the spans' offsets by text."""
    offsets = np.searchsorted(span_start, starts)
    return np.repeat(np.arange(len(starts) - 1), np.diff(offsets)), offsets


def ragged(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions ``begins[i] .. begins[i] + lengths[i] - 1`` of all i in one array."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(begins, np.int64) - at, lengths)

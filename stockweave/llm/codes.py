"""Vector code compression: product quantisation in exact integers.

A vector's components are scaled to integers, ``floor(256 * x)``, and cut into equal
consecutive parts.  Each part position has a codebook; a part's code is the index of
its nearest entry by squared Euclidean distance, of equal ones the lowest.  Codebooks
begin as the parts of the vectors with the smallest ids and are trained by rounds of
assigning all parts and replacing each entry by the floor of its parts' mean.

Nearest entries are found by segment means.  For a block of ``L`` components with mean
``m`` and residual norm ``r`` (the norm of what is left when the mean is taken off),
``L (m_x - m_c)^2 + (r_x - r_c)^2`` never exceeds the squared distance, and the sum
over the blocks of a part gets tighter as blocks are halved.  The entry with the
least coarse bound gives a true distance; whatever entries' bounds exceed it fall
out, level by level from the whole part as one block, and only survivors get their
exact integer distance.  Bounds are floating point, so they are lowered by more
than their rounding error first: no nearest entry and no tie can fall out.

Scale.  A round is one scan: a task sums its parts by entry and passes on one row for
each component of each entry, whatever number of vectors it has.  Their totals, a
number fixed by ``parts``, ``entries`` and the dimension, come to the driver, and the
codebooks go out with the next round.  Sums are exact, so neither partitions nor
retries change a result.  The error by label is summed before it is joined; labels with
more rows than a task should hold are joined by broadcast (their number is bounded by
the number of tasks), all others by shuffle.

Edge cases.  Vectors that are null, or hold null or non-finite components or any
beyond ``LARGEST``, are dropped.  The dimension is the most frequent length (of ties
the least) that ``parts`` divides; vectors of other lengths are dropped, too.  Rows
that repeat an id are coded each; the smallest of their vectors is the seed.  A null id
comes last.  Fewer ids than entries make smaller codebooks.  Codes have as many hex
digits as the greatest index needs, two at least.  Error sums beyond a long are its
greatest value.  An empty table gives none.  Other columns pass through, but for those
named like a new column, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond count as not finite; sums of all others fit a decimal of 38 digits.
LARGEST = 2.0**80
#: Integers up to here have squared distances of whole vectors that fit 64 bits.
_NARROW = 1 << 26
_LONG = 2**63 - 1
#: A bound is lowered by this share of both squared norms: thousands of rounding errors.
_SLACK = 1e-11
#: Rows compared at once: their bounds stay in a core's cache.
_ROWS = 256


@dataclass
class Codebooks:
    """``entries[part][index]`` is a list of integers."""

    dimension: int
    parts: int
    entries: list[list[list[int]]]

    def sha256(self) -> str:
        flat = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        """An array of each part's entries, of Python integers where 64 bits won't do."""
        widest = max((abs(x) for part in self.entries for entry in part for x in entry), default=0)
        return [np.array(part, np.int64 if widest < _NARROW else object) for part in self.entries]


def _total(columns: list[np.ndarray]) -> np.ndarray:
    return reduce(np.add, columns)


def _blocks(x: np.ndarray, n: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, sum and residual norm of each of ``n`` blocks; ``x`` has a row for each component."""
    out = []
    for block in np.array_split(x, n):
        size, total = len(block), _total(block)
        rest = size * _total(block * block) - total * total  # exact, never negative
        out.append((size, total, np.sqrt(rest.astype(np.float64) / size)))
    return out


def _bound(x: list, c: list, pick=lambda of_row: of_row[:, None], to=slice(None)) -> np.ndarray:
    """The lower bound of the squared distance of rows of x and entries c: of all, or of picked pairs."""
    parts = []
    for (size, sx, rx), (_, sc, rc) in zip(x, c):
        apart, rest = (pick(sx) - sc[to]).astype(np.float64), pick(rx) - rc[to]
        apart *= apart
        rest *= rest
        parts.append(apart / size + rest)
    return _total(parts)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coarse = _bound(_blocks(x, 1), _blocks(c, 1))
    known = _total((x - c[:, coarse.argmin(axis=1)]) ** 2).astype(np.float64)  # a true distance
    norms = _total(x * x).astype(np.float64) + float(_total(c * c).max())
    limit = known + _SLACK * (known + norms)
    row, entry = np.divmod(np.flatnonzero(coarse <= limit[:, None]), c.shape[1])
    blocks = 2
    while blocks < len(c):
        fine = _bound(_blocks(x, blocks), _blocks(c, blocks), lambda of_row: of_row[row], entry)  # noqa: B023
        left = np.flatnonzero(fine <= limit[row])
        row, entry, blocks = row[left], entry[left], 2 * blocks
    distance = _total([(a[row] - b[entry]) ** 2 for a, b in zip(x, c)])
    every = np.arange(x.shape[1])
    least = np.minimum.reduceat(distance, np.searchsorted(row, every))
    hit = np.flatnonzero(distance == least[row])
    return entry[hit[np.searchsorted(row[hit], every)]], least


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, of ties the lowest, and its squared distance."""
    columns, entries = np.ascontiguousarray(x.T), np.ascontiguousarray(c.T)
    found = [_nearest(columns[:, i : i + _ROWS], entries) for i in range(0, len(x), _ROWS)]
    return tuple(map(np.concatenate, zip(*found)))


def _integers(column: pa.ListArray, dimension: int) -> np.ndarray:
    """The scaled components of a batch, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    scaled = np.floor(SCALE * flat)
    if not scaled.size or np.abs(scaled).max() < _NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object)


def usable(vectors: DataFrame, column: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that can be coded, with components as doubles, and their dimension (0 if there are none)."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    kept = vectors.withColumn(column, x.cast("array<double>")).filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~bad)
    lengths = kept.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), "length").first()
    return (kept.filter(F.size(column) == lengths.length), lengths.length) if lengths else (kept, 0)


def _seeds(kept: DataFrame, dimension: int, id_column: str, column: str, parts: int, entries: int) -> Codebooks:
    ids = kept.select(F.col(id_column).alias("id")).distinct().orderBy(F.asc_nulls_last("id")).limit(entries)
    at = kept.select(F.col(id_column).alias("seed"), F.col(column).alias("x"))
    own = at.join(F.broadcast(ids), F.col("seed").eqNullSafe(F.col("id"))).groupBy("id").agg(F.min("x").alias("x"))
    first = [[int(np.floor(SCALE * v)) for v in r.x] for r in own.orderBy(F.asc_nulls_last("id")).collect()]  # ``entries`` rows
    width = dimension // parts
    return Codebooks(dimension, parts, [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)])


def _sums(kept: DataFrame, books: Codebooks, column: str) -> DataFrame:
    """Of each entry of each part that has parts: their number and sums by component."""
    dimension, width = books.dimension, books.dimension // books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        total = [np.zeros(c.shape, object) for c in arrays]
        number = [np.zeros(len(c), np.int64) for c in arrays]
        for b in batches:
            x = _integers(b.column(0), dimension)
            for p, c in enumerate(arrays if len(x) else ()):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(own, c)
                order = np.argsort(entry, kind="stable")
                used, begin = np.unique(entry[order], return_index=True)
                number[p] += np.bincount(entry, minlength=len(c))
                total[p][used] += np.add.reduceat(own[order], begin, axis=0).astype(object)
        rows = [(p, e, i, int(number[p][e]), int(total[p][e, i])) for p in range(len(arrays)) for e in np.flatnonzero(number[p]) for i in range(width)]
        p, e, i, n, s = zip(*rows) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.decimal128(38, 0))], names=["part", "entry", "at", "n", "total"])

    partial = frames.arrow(kept.select(column), run, "part int, entry int, at int, n long, total decimal(38,0)")
    return partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all usable vectors."""
    kept, dimension = usable(vectors, column, parts)
    if not dimension:
        return Codebooks(0, parts, [])
    books = _seeds(kept, dimension, id_column, column, parts, entries)
    for _ in range(rounds):
        new = [[list(entry) for entry in part] for part in books.entries]
        for r in _sums(kept, books, column).toLocalIterator():  # a row for each component of each entry
            new[r.part][r.entry][r["at"]] = int(r.total) // r.n
        books = Codebooks(dimension, parts, new)
    return books


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding", names: tuple[str, str] = ("code", "error")) -> DataFrame:
    """The usable rows with ``code``, hex digits in part order, in place of the vector, and ``error``, the squared distance to what it stands for."""
    rest = [c for c in vectors.columns if c != column and c.lower() not in names]
    schema = T.StructType([*vectors.select(rest).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])
    if not books.dimension:
        return vectors.sparkSession.createDataFrame([], schema)
    kept, _ = _of_length(vectors, column, books)
    dimension, width, fields = books.dimension, books.dimension // books.parts, [*rest, *names]
    digits = max(2, len(f"{max(map(len, books.entries)) - 1:x}"))
    hexed = np.array([f"{i:0{digits}x}" for i in range(max(map(len, books.entries)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        for b in batches:
            x = _integers(b.column(len(rest)), dimension)
            code, error = [[""] * len(x)], 0
            for p, c in enumerate(arrays if len(x) else ()):
                entry, distance = nearest(x[:, p * width : (p + 1) * width], c)
                code.append(hexed[entry].tolist())
                error = error + distance
            errors = [min(int(e), _LONG) for e in error] if len(x) else []
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], pa.array(map("".join, zip(*code)), pa.string()), pa.array(errors, pa.int64())], names=fields)

    return frames.arrow(kept.select(*rest, column), run, schema)


def _of_length(vectors: DataFrame, column: str, books: Codebooks) -> tuple[DataFrame, int]:
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    return vectors.withColumn(column, x.cast("array<double>")).filter(x.isNotNull() & (F.size(x) == books.dimension) & ~bad), books.dimension


def decode(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for: its entries' components, scaled back."""
    digits = max(2, len(f"{max(map(len, books.entries)) - 1:x}"))
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in books.entries])
    index = lambda p: F.conv(F.substr(code, p * digits + 1, F.lit(digits)), 16, 10).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(books.parts - 1)), lambda p: F.get(F.get(table, p), index(p))))


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """Adds the error summed over rows with an equal label, nulls together."""
    if name in coded.columns:
        coded = coded.drop(name)
    own, rows = frames.fresh(coded, "own"), frames.fresh(coded, "rows")
    total = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = frames.keep(coded.groupBy(F.col(label).alias(own)).agg(total.alias(name), F.count(F.lit(1)).alias(rows)))
    share = 4 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = F.col(rows) * share > (sums.agg(F.sum(rows)).first()[0] or 0)
    hot, cold = (sums.filter(c).drop(rows) for c in (often, ~often))  # fewer than ``share`` labels are hot
    same = F.col(label).eqNullSafe(F.col(own))
    marked = coded.join(F.broadcast(hot), same, "left")
    found = marked.filter(F.col(name).isNotNull()).drop(own)
    rest = marked.filter(F.col(name).isNull()).drop(own, name).join(cold.hint("merge"), same).drop(own)
    return found.unionByName(rest)


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Codebooks trained on all vectors, and the code and errors of each."""
    books = train(vectors, id_column, column)
    coded = frames.keep(encode(vectors.select(id_column, column, label), books, column))
    return with_label_error(coded, label).withColumn("codebooks_sha256", F.lit(books.sha256()))

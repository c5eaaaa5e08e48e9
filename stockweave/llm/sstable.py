"""Token-ID output: sorted string tables of documents keyed by identifier.

File format of a shard, all integers little-endian:

* blocks, each compressed with zstd: entries in ascending key order, each of
  ``shared:u8  rest:u8  size:u32  rest bytes of the key  value``; the key's first
  ``shared`` bytes are those of the entry before it in the block;
* the index: per block ``length of first key:u8, first key, offset:u64,
  length:u32, entries:u32, tokens:u64``;
* a Bloom filter over the keys: ``hashes:u8, bits``;
* the footer, ``FOOTER.size`` bytes: places of index and filter, entries,
  tokens, bytes of a token id, crc32 of index and filter, ``MAGIC``.

A key is 0x00 for a null identifier, else 0x01 and the signed 64-bit number with
its sign bit turned, big-endian: byte order is number order, null first.  A
value is the token ids, 2 bytes each if the vocabulary allows, else 4.

Texts are dealt to ranges of the key and sorted, encoded, and written shard by
shard through ``pyarrow.fs`` to the shared folder.  A shard is written under a
name of its task attempt and renamed, so an attempt that is lost or repeated
leaves whole shards only.  Memory: one shard's index and one block.

Edge cases.  Null and empty texts have the end token alone.  Null identifiers
are kept, first.  Repeated identifiers are kept side by side; a lookup returns
all of them.  An empty table has no shard.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, kernel, tokens

MAGIC = b"SWSST01\n"
FOOTER = struct.Struct("<QQQQQQBI8s")
_ENTRY = struct.Struct("<BBI")
_PLACE = struct.Struct("<QIIQ")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
BITS_PER_KEY = 10
HASHES = 7
MANIFEST = "part int, shard int, path string, entries long, tokens long, bytes long"
_MANIFEST = [("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]


def key_of(value: int | None) -> bytes:
    return b"\0" if value is None else b"\1" + (value + (1 << 63)).to_bytes(8, "big")


def value_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _bit_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """One shard, written to a binary stream in one pass."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.first, self.last, self.in_block, self.block_tokens = bytearray(), b"", b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.in_block and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        else:
            self.first = key
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.block_tokens += len(ids)
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = self.zstd.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(bytes([len(self.first)]) + self.first + _PLACE.pack(self.at, len(data), self.in_block, self.block_tokens))
            self.at += len(data)
            self.entries += self.in_block
            self.tokens += self.block_tokens
            self._begin()

    def close(self) -> int:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(-(-bits // 8) * 8, np.uint8)
        bloom[[p for k in self.keys for p in _bit_places(k, len(bloom))]] = 1
        packed = bytes([HASHES]) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.tokens, self.width, zlib.crc32(packed, zlib.crc32(index)), MAGIC))
        return self.at + len(index) + len(packed) + FOOTER.size


class Reader:
    """Reads a shard by way of its footer: blocks in order, or single keys."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.tokens, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        index = file.read(n)
        bloom = file.read(bloom_n)
        if zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError("damaged index or filter")
        self.bloom = np.unpackbits(np.frombuffer(bloom[1:], np.uint8), bitorder="little")
        self.firsts, self.places, k = [], [], 0
        while k < n:
            m = index[k]
            self.firsts.append(index[k + 1 : k + 1 + m])
            self.places.append(_PLACE.unpack_from(index, k + 1 + m))
            k += 1 + m + _PLACE.size

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        at, n, entries, _ = self.places[i]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(n))
        key, k = b"", 0
        for _ in range(entries):
            shared, rest, size = _ENTRY.unpack_from(data, k)
            k += _ENTRY.size
            key = key[:shared] + data[k : k + rest]
            k += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, k)
            k += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, value: int | None) -> list[np.ndarray]:
        """Values of a key: filter, then binary search in the index, then its blocks."""
        key = key_of(value)
        if not all(self.bloom[p] for p in _bit_places(key, len(self.bloom))):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Write the shards; one row per shard, in the order of part, shard, key."""
    width = 2 if tokens.vocabulary_size(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.encoder(tokenizer), TaskContext.get()
        system, base = _file_system(folder)
        part, shard, made, writer, stream, temporary = task.partitionId(), 0, [], None, None, ""

        def finish() -> None:
            nonlocal writer, shard
            size = writer.close()
            stream.close()
            path = f"{base}/part-{part:06d}-{shard:04d}.sst"
            system.move(temporary, path)
            made.append((part, shard, path, writer.entries, writer.tokens, size))
            shard, writer = shard + 1, None

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi, text, starts in kernel.blocks(b.column(1), 1 << 20):
                ids, counts = encoder.encode_block(text, starts)
                cuts = np.cumsum(counts)
                ids = np.insert(ids, cuts, end_id)
                ends = (cuts + np.arange(1, hi - lo + 1)).tolist()
                for i, (m, e) in enumerate(zip(counts.tolist(), ends)):
                    if writer is None:
                        system.create_dir(base, recursive=True)
                        temporary = f"{base}/_{part}-{shard}-{task.taskAttemptId()}"
                        stream = system.open_output_stream(temporary)
                        writer = Writer(stream, width, block_bytes)
                    writer.add(key_of(keys[lo + i]), ids[e - m - 1 : e])
                    if writer.at >= shard_bytes:
                        finish()
        if writer is not None:
            finish()
        if made:
            yield frames.batch(_MANIFEST, list(zip(*made)))

    dealt = docs.select(id_column, text_column).repartitionByRange(n, id_column).sortWithinPartitions(id_column)
    return frames.arrow(dealt, run, MANIFEST)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = [(c.split()[0], pa.int64()) for c in READ.split(", ")]


def read_digest(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back: per document its place, length and checksum.

    ``manifest`` has a row per shard (one for each 32 MB); the driver sums up the
    tokens of the parts, one number for each task that wrote, and a window those of
    a part's shards; a task then reads whole shards."""
    manifest = frames.keep(manifest)
    parts, before, shards_in_all = [], 0, 0
    for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("shards")).orderBy("part").collect():
        parts.append((r.part, before))
        before, shards_in_all = before + r.n, shards_in_all + r.shards
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.withColumn("within", F.coalesce(F.sum("tokens").over(in_part), F.lit(0)))
    rows = rows.join(F.broadcast(manifest.sparkSession.createDataFrame(parts, "part int, first long")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple] = []
                with system.open_input_file(path) as f:
                    for key, ids in Reader(f):
                        out.append((value_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= 20_000:
                            yield frames.batch(_READ, list(zip(*out)))
                            out = []
                if out:
                    yield frames.batch(_READ, list(zip(*out)))

    shards = rows.select("path", (F.col("first") + F.col("within")).alias("start"))
    return frames.arrow(shards.repartition(max(1, shards_in_all)), run, READ)

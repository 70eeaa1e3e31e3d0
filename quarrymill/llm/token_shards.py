"""Token ids in sorted-string-table shards.

A shard file, little-endian:

    data blocks   each zstd; inside: entries of  varint shared, varint unshared, varint n, unshared key bytes, n ids
                  (16 bits each where the shard's ids fit, else 32).  A key is the doc_id as 8 big-endian bytes with
                  the sign bit flipped, so bytes sort as numbers; entries share the key's prefix with the one before.
    Bloom filter  bits of all keys, two probes from halves of one 64-bit hash, stepped
    block index   for each block: last key (8), offset (8), packed size (4), entries (4), ids (8)
    footer        magic, version, id width, and offset and size of filter and index, counts, first and last key (fixed size)

``write`` deals documents by ranges of doc_id and a hash of the text, so that an id with very many rows is spread, too;
it sorts each range and rolls shards of a bounded size and number of keys into the shared folder.  A task writes under a
name of its own and renames when done, so a repeated attempt leaves whole files only.  Its manifest, a row a shard, is a
table; how many ids stand before a shard is a prefix sum over it.  ``read`` walks the shards block by block, ``lookup``
asks the filter, then searches the index by halves.

Null texts count as empty and hold the end id alone.  Rows with a null doc_id sort first under the smallest key.
Repeated doc_ids are kept as separate entries, ordered by the hash of their text.  Texts of any length are encoded whole.
Other columns are neither needed nor touched, whatever their names; an empty table gives no shard and an empty result.  The
folder belongs to the caller: shards are its output and stay.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import json_encoder
from .common import bound_batches, materialize, scratch_path, shuffle_slices, tidy

MAGIC, VERSION, END_ID = b"QMSST001", 1, 2
#: A block is full at so many ids, a shard at so many ids or keys.
BLOCK_IDS, SHARD_IDS, SHARD_KEYS = 32_768, 16_000_000, 1_000_000
BITS_A_KEY, PROBES, ROWS = 10, 6, 20_000
FOOTER = struct.Struct("<8sIIQQQQQQ8s8s")
INDEX = struct.Struct("<8sQIIQ")
_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_bytes(doc_id: int) -> bytes:
    return ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_number(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys in a filter, a row of PROBES for each."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def filesystem(path: str):
    """(file system, path in it) of a URI; where pyarrow has no such file system, fsspec is not assumed and this raises."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ShardWriter:
    """add() documents in ascending order of doc_id, then close() for the bytes of the file's tail."""

    def __init__(self, out, width: int):
        self.out, self.width, self.place = out, width, 0
        self.block, self.last, self.entries, self.ids = [], b"", 0, 0
        self.index, self.keys, self.n_ids, self.pack = [], [], 0, zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key, shared = key_bytes(doc_id), 0
        while shared < min(8, len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += [varint(shared), varint(8 - shared), varint(len(ids)), key[shared:], ids.astype(f"<u{self.width}").tobytes()]
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        self.keys.append(doc_id)
        if self.ids >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.entries:
            data = self.pack.compress(b"".join(self.block))
            self.index.append(INDEX.pack(self.last, self.place, len(data), self.entries, self.ids))
            self.out.write(data)
            self.place += len(data)
            self.n_ids += self.ids
            self.block, self.last, self.entries, self.ids = [], b"", 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS_A_KEY * len(self.keys))
        filled = np.zeros(bits, bool)
        if self.keys:
            filled[_bits(np.array(self.keys, np.int64).view(np.uint64), bits).ravel()] = True
        bloom, index = np.packbits(filled, bitorder="little").tobytes(), b"".join(self.index)
        ends = [key_bytes(k) for k in (self.keys[0], self.keys[-1])] if self.keys else [b"\0" * 8] * 2
        self.out.write(bloom + index + FOOTER.pack(MAGIC, VERSION, self.width, self.place, bits, self.place + len(bloom), len(self.index), len(self.keys), self.n_ids, *ends))
        self.out.close()


class ShardReader:
    def __init__(self, path: str):
        system, place = filesystem(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        magic, version, self.width, self.bloom_at, self.bits, index_at, blocks, self.n_docs, self.n_ids, self.first, self.last = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is no shard of this version")
        self.index = list(INDEX.iter_unpack(self.file.read_at(blocks * INDEX.size, index_at)))

    def close(self) -> None:
        self.file.close()

    def block(self, number: int):
        """(doc_id, ids) of a block's entries."""
        _, place, size, entries, ids = self.index[number]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, place), max_output_size=ids * self.width + entries * 32)
        at, key = 0, b""
        for _ in range(entries):
            head = []
            for _ in range(3):
                value = shift = 0
                while True:
                    byte = data[at]
                    at += 1
                    value |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                head.append(value)
            shared, unshared, n = head
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key_number(key), np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def __iter__(self):
        for number in range(len(self.index)):
            yield from self.block(number)

    def may_hold(self, doc_id: int) -> bool:
        bits = _bits(np.array([doc_id], np.int64).view(np.uint64), self.bits)[0]
        data = np.frombuffer(self.file.read_at((self.bits + 7) // 8, self.bloom_at), np.uint8)
        return bool((data[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).all())

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each entry of a key; none if it isn't there."""
        key, found = key_bytes(doc_id), []
        if self.n_docs and self.first <= key <= self.last and self.may_hold(doc_id):
            number = bisect_left([x[0] for x in self.index], key)
            while number < len(self.index):
                rows = [(k, ids) for k, ids in self.block(number) if k >= doc_id]
                found += [ids for k, ids in rows if k == doc_id]
                if not rows or rows[-1][0] > doc_id:
                    break
                number += 1
        return found


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Writes the shards when its rows are asked for, which must be once: the manifest, a few rows for each range."""

    def run(batches):
        encoder, part, seq, writer, names = json_encoder(tokenizer), TaskContext.get().partitionId(), 0, None, None
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        system, root = filesystem(folder)

        def finish():
            writer.close()
            system.move(names[0], names[1])
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{os.path.basename(names[1])}", "n_docs": len(writer.keys), "n_ids": writer.n_ids}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for at, ids, off in encoder.blocks(batch.column(1)):
                keys = batch.column(0).slice(at, len(off) - 1).to_pylist()
                ids = np.insert(ids.astype(np.uint32), off[1:], end_id)
                off = (off + np.arange(len(off))).tolist()
                for key, a, b in zip(keys, off[:-1], off[1:], strict=True):
                    if writer is None:
                        name = f"{root}/shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}"
                        names = (f"{name}.part", f"{name}.qms")
                        system.create_dir(root, recursive=True)
                        writer = ShardWriter(system.open_output_stream(names[0]), width)
                    writer.add(-(1 << 63) if key is None else key, ids[a:b])
                    if writer.n_ids + writer.ids >= shard_ids or len(writer.keys) >= shard_keys:
                        yield finish()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield finish()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_slices(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    return ranged.select("doc_id", "text").mapInArrow(tidy(run), _MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files alone; manifest: the written rows of write()."""
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row a range
    base = parts.select("part", earlier(Window.orderBy("part")).alias("base"))
    placed = manifest.withColumn("inside", earlier(Window.partitionBy("part").orderBy("seq"))).join(base, "part")
    many = min(max(1, manifest.count()), 4 * shuffle_slices(manifest.sparkSession))
    shards = placed.select("path", (F.col("base") + F.col("inside")).alias("before")).repartition(many, "path")

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, out = ShardReader(path), [[], [], [], []]
                for key, ids in reader:
                    for column, value in zip(out, (key, start, len(ids), zlib.crc32(ids.astype("<u4"))), strict=True):
                        column.append(value)
                    start += len(ids)
                    if len(out[0]) >= ROWS:
                        yield rows_of(out)
                        out = [[], [], [], []]
                reader.close()
                yield rows_of(out)

    return shards.mapInArrow(tidy(run), _ROWS)


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """The round trip: shards in folder (the session's shared one if None), then one row a document read from them."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or scratch_path(spark, "token-shards")
    out = read(materialize(write(docs, folder, tokenizer, **options), "shard-manifest"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))

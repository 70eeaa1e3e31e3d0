"""Line dedup with two Bloom filters.

1. Each task hashes the keys of its lines and sends every distinct hash once, 8 bytes of it and nothing of the line, to
   the slice whose part of the two filters it belongs to, with a mark if two of its own documents hold it.  A slice passes
   its blocks through its Bloom filters, for hashes seen once and seen twice, sized by what it has received; the number of
   slices follows the size of the texts.  What the second filter holds in the end is a suspected repeat.
2. A second pass asks a Bloom filter of the suspects, of bounded size, for each line; only lines that it holds shuffle.
   Their keys are grouped in full, which confirms repeats exactly and gives the first document of each; a false alarm of
   any filter dies here, and none can hide a repeat.
3. Documents that lose lines get the keys that they lose by a join; all others pass by the shuffle.

A key is the line without white space at its ends, A-Z lower-cased; it counts from MIN_KEY code points on, and repeats
within one document don't count.  Hot keys are no burden: counts are pre-aggregated, and the look-up of first documents
broadcasts the at most HEAVY_SHARE keys that hold over a thousandth of the rows.

Null and empty texts are one empty line.  Rows with the same doc_id are one document for the count and lose the same keys.
Rows without doc_id hold no key for others and lose no line.  Texts of any length are taken whole, in Arrow batches of bounded
size.  Ties cannot occur, since doc_id decides.  Other columns are neither needed nor touched, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_filter, lookup_few, materialize, skew_safe_lookup, slices_for, tidy

MIN_KEY = 10
BITS_A_KEY, PROBES = 16, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMITTED = 1 << 16
_BLOCK = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line, b"" for those that don't count."""
    keys = [line.strip() for line in raw.translate(_LOWER).split(b"\n")]
    if raw.isascii():
        return [k if len(k) >= MIN_KEY else b"" for k in keys]
    return [k if len(k) >= MIN_KEY and (len(k) >= 4 * MIN_KEY or len(k.decode("utf-8", "replace")) >= MIN_KEY) else b"" for k in keys]


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


class Bloom:
    """A filter over 64-bit hashes; the hashes are mixed already, so their halves serve as two hash functions."""

    def __init__(self, keys: int):
        self.bits = np.uint64(max(64, BITS_A_KEY * keys))
        self.words = np.zeros((int(self.bits) + 7) // 8, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
        return (a[:, None] * np.uint64(0x9E3779B1) + b[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) % self.bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        return (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        at = self._places(hashes).ravel()
        np.bitwise_or.at(self.words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def hash_blocks(docs: DataFrame, slices: int) -> DataFrame:
    """Distinct hashes of each batch, by slice: those of one document of the batch, and those of several."""

    def run(batches):
        for batch in batches:
            hashes, owner = [], []
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), strict=True):
                own = {key_hash(k) for k in set(line_keys(raw)) if k}
                hashes += own
                owner += [doc_id] * len(own)
            h, o = np.array(hashes, np.uint64), np.array(owner, np.int64)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            several = np.maximum.reduceat(o, first) != np.minimum.reduceat(o, first) if len(h) else np.zeros(0, bool)
            h = h[first]
            to = (h >> np.uint64(40)) % np.uint64(slices)
            order = np.argsort(to, kind="stable")
            h, to, several = h[order], to[order], several[order]
            cuts = np.searchsorted(to, np.arange(slices + 1))
            rows = [(s, h[a:b][~several[a:b]].tobytes(), h[a:b][several[a:b]].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 3, _BLOCK, strict=True)], schema=_BLOCK)

    return docs.mapInArrow(tidy(run), "slice int, once binary, twice binary")


def suspects(blocks: DataFrame, slices: int) -> DataFrame:
    """Hashes that more than one document seems to hold."""

    def run(batches):
        held = [(s, once, twice) for b in batches for s, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        size = sum(len(once) + len(twice) for _, once, twice in held) // 8
        seen_once, seen_twice = Bloom(size), Bloom(size)
        for _, once, twice in held:
            once, twice = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
            seen_twice.add(np.concatenate([once[seen_once.holds(once)], twice]))
            seen_once.add(once)
            seen_once.add(twice)
        # asked only when it is full: it then holds every repeat, and what it holds by chance is one suspect more
        again = [h[seen_twice.holds(h)] for _, *both in held for h in (np.frombuffer(b, np.uint64) for b in both)]
        again = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint64)
        for at in range(0, len(again), _EMITTED):
            yield pa.RecordBatch.from_arrays([pa.array(again[at : at + _EMITTED].view(np.int64))], ["hash"])

    return blocks.repartition(slices, "slice").mapInArrow(tidy(run), "hash long")


def suspected_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key) of the lines whose hash is suspected, once a document."""
    holds = broadcast_filter(found, F.col("hash"))

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), strict=True):
                own = [k for k in dict.fromkeys(line_keys(raw)) if k]
                keys += own
                ids += [doc_id] * len(own)
            keep = np.flatnonzero(holds(np.fromiter(map(key_hash, keys), np.uint64, len(keys)))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([keys[i] for i in keep], pa.binary())], ["doc_id", "key"])

    return docs.mapInArrow(tidy(run), "doc_id long, key binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 and, with_text, the text that is left."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    # a hash of 8 bytes for a line of 10 code points and its end at least
    slices = slices_for(spark, named.agg(F.sum(F.octet_length("text"))).first()[0])
    found = materialize(suspects(hash_blocks(named, slices), slices), "suspected-hashes")
    lines = materialize(suspected_lines(named, found), "suspected-lines")
    first = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where(F.col("first") < F.col("last"))
    first = materialize(first.select("key", "first", "n"), "confirmed-lines")
    lost = skew_safe_lookup(lines.select("doc_id", "key"), first, ["key"], "n", lines.count(), how="inner").where(F.col("doc_id") > F.col("first"))
    # the keys of one document, no more than its lines
    per_doc = lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", text string" if with_text else "")

    def run(batches):
        for batch in batches:
            out = []
            for raw, lost_keys in zip(pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, dropped = raw.split(b"\n"), 0
                if lost_keys:
                    lost_keys = set(lost_keys)
                    kept = [line for line, key in zip(lines, line_keys(raw), strict=True) if not key or key not in lost_keys]
                    dropped = len(lines) - len(kept)
                    raw = b"\n".join(kept)
                out.append((len(lines), dropped, hashlib.sha256(raw).hexdigest(), raw))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(columns[3], pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return lookup_few(docs, materialize(per_doc, "lost-lines"), "doc_id", run, schema)

"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte, and how often each pair does so.

Texts.  Space and text are encoded by A, a byte-level BPE of the tokenizers library, and by B, a sentencepiece model that
adds that space itself.  Byte offsets where tokens of both end cut them into groups; the two tokens that end there are a
link.  A document whose bytes either side does not give back has no tokens.  A task packs BLOCK_LINKS links into a block:
its distinct pairs of ids with their counts, cut into stripes of STRIPE_IDS ids of B, and for each document the places of
its links among them.

Counts.  The pairs of a stripe meet in one partition, where a dense matrix (ids of B in the stripe by ids of A) adds them up; the
maxima of its rows give the best.  A stripe that many blocks have is salted: parts of it are added up first.

Scores.  The matrices go to the same partitions as the pairs of the blocks, by stripe and salt, and give each pair its count and
whether it is the best; a block's scores meet its documents by block.  A task holds one matrix, or one block's scores.

Nulls and empty texts have zeros and an empty column groups_sha256.  A row gives a row, whether its doc_id is shared or
null.  Ties: each pair with the highest count of its id of B is the best.  A text of more than PIECE_BYTES is cut before single
spaces between ASCII letters or digits, where no token of either side crosses; it may fill several blocks and is encoded
twice, to see first whether its bytes come back; a stretch without such a place is encoded in one go.  Other columns are
neither needed nor touched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import bound_batches, materialize, quoted, slices_for, tidy

STRIPE_IDS, BLOCK_LINKS, PIECE_BYTES = 64, 1_000_000, 1_000_000
#: Rows of a stripe, one a block, that a task adds up before they are joined.
SALT_ROWS = 4_000
_CUT = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_BLOCKS = "kind int, block long, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, stripe int, first int, size int, data binary, counts binary"
_PACKED = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("block", "row", "doc_id", "n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), *((c, pa.int32()) for c in ("stripe", "first", "size")), ("data", pa.binary()), ("counts", pa.binary())])
_NONE = np.zeros(0, np.int64)


class Side:
    """ids(texts) and the bytes of each id: data, starts."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.size = encode, len(tokens)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.widths = np.diff(self.starts)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        many = self.widths[ids]
        ends = np.cumsum(many)
        return self.data[np.repeat(self.starts[ids] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]


def byte_side(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encoder = Encoder(tokenizer)  # knows no special tokens, so their strings are plain text
    back = {c: b for b, c in encoder.chars.items()}
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, off = encoder.encode(pa.array([" " + t for t in texts], pa.large_string()))
        return ids.astype(np.int64), np.asarray(off, np.int64)

    return Side(encode, tokens)


def piece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = model.encode(texts, num_threads=1)
        many = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int64, int(many.sum())), np.concatenate([[0], np.cumsum(many)])

    return Side(encode, tokens)


class Aligner:
    """Two sides, and the decimal names of their ids with the sign that follows them."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        names = [np.array([f"{i}{sign}".rjust(8, "\0") for i in range(side.size)], "S8") for side, last in ((a, "|"), (b, ";")) for sign in (",", last)]
        self.signs = np.concatenate(names).view(np.uint8).reshape(-1, 8)
        self.sign_widths = (self.signs != 0).sum(axis=1)

    def whole(self, raws: list[bytes]) -> tuple[np.ndarray, tuple, tuple]:
        """(texts whose bytes both sides give back, (ids, offsets) of A, of B)."""
        texts = [r.decode() for r in raws]
        out, good = [], np.fromiter((bool(r) for r in raws), bool, len(raws))
        for side in (self.a, self.b):
            ids, off = side.encode(texts)
            data = side.bytes_of(ids).tobytes()
            ends = np.concatenate([[0], np.cumsum(side.widths[ids])])[off].tolist()
            good &= np.fromiter((data[s:e] == b" " + r for r, s, e in zip(raws, ends[:-1], ends[1:], strict=True)), bool, len(raws))
            out.append((ids, off))
        return good, *out

    def align(self, raws: list[bytes]):
        """good texts, then per good text n_a, n_b, n_groups and the bytes of its groups, then A's and B's ids of all links."""
        good, *sides = self.whole(raws)
        ids, many, ends = [], [], []
        for side, (i, off) in zip((self.a, self.b), sides, strict=True):
            n = np.diff(off)
            i = i[np.repeat(good, n)]
            ids.append(i)
            many.append(n[good])
            ends.append(np.cumsum(side.widths[i]))
        (a, b), (end_a, end_b) = ids, ends
        at_end = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
        at_end[end_a] = 1
        at_end[end_b] += 2
        last_a, last_b = at_end[end_a] == 3, at_end[end_b] == 3
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        first_a, first_b = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (last_a, last_b))
        sign = np.empty(len(a) + len(b), np.int64)
        sign[np.arange(len(a)) + first_b[group_a]] = a + np.where(last_a, self.a.size, 0)
        sign[np.arange(len(b)) + first_a[group_b + 1]] = b + np.where(last_b, self.b.size, 0) + 2 * self.a.size
        flat = self.signs[sign].ravel()
        flat = flat[flat != 0].tobytes()
        widths = np.concatenate([[0], np.cumsum(self.sign_widths[sign])])
        cuts = widths[np.concatenate([[0], np.cumsum(many[0] + many[1])])].tolist()
        groups = [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        before = np.concatenate([[0], np.cumsum(last_a)])
        n_groups = np.diff(before[np.concatenate([[0], np.cumsum(many[0])])])
        return good, many[0], many[1], n_groups, groups, a[last_a], b[last_b]


_ALIGNERS: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, which Spark uses again."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(byte_side(path_a), piece_side(path_b))
    return _ALIGNERS[path_a, path_b]


def segments(raw: bytes):
    """A long text in parts of some PIECE_BYTES; the space before each part but the first is left out."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        cut = _CUT.search(raw, at + PIECE_BYTES)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


class Block:
    """Links of documents until they are packed."""

    def __init__(self, part: int, stride: int):
        self.part, self.stride, self.nth = part, stride, 0
        self.rows, self.codes, self.many, self.size = [], [], [], 0

    def add(self, rows: list[tuple], many: np.ndarray, code: np.ndarray) -> None:
        """rows: (row, doc_id, n_a, n_b, n_groups, sha); many: links of each."""
        self.rows += rows
        self.codes.append(code)
        self.many.append(many)
        self.size += len(code)

    def pack(self, stripe_ids: int) -> pa.RecordBatch:
        code, many = np.concatenate(self.codes), np.concatenate(self.many)
        names, place, counts = np.unique(code, return_inverse=True, return_counts=True)
        block, cuts = (self.part << 33) | self.nth, np.cumsum(many).tolist()
        owner = np.repeat(np.arange(len(many), dtype=np.uint64), many)
        place = (np.sort((owner << np.uint64(32)) | place.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(0, block, *row, None, None, 4 * int(n), place[e - n : e].tobytes(), None) for row, n, e in zip(self.rows, many.tolist(), cuts, strict=True)]
        width = stripe_ids * self.stride
        stripe = names // width
        first = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])) if len(names) else _NONE
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(names)], strict=False):
            here = int(stripe[s])
            rows.append((1, block, *[None] * 6, here, s, 8 * (e - s), (names[s:e] - here * width).astype(np.uint32).tobytes(), counts[s:e].astype(np.uint32).tobytes()))
        self.nth += 1
        self.rows, self.codes, self.many, self.size = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def link_blocks(docs: DataFrame, path_a: str, path_b: str, stripe_ids: int, block_links: int) -> DataFrame:
    """Kind 0: a document, or a part of a long one, with the places of its links in the block; kind 1: a block's pairs of a stripe."""

    def short(both: Aligner, keys: list[tuple], raws: list[bytes]):
        good, n_a, n_b, n_groups, groups, a, b = both.align(raws)
        digest = iter(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), (hashlib.sha256(g[:-1]).hexdigest() for g in groups), strict=True))
        rows = [(*key, *(next(digest) if ok else (0, 0, 0, ""))) for key, ok in zip(keys, good.tolist(), strict=True)]
        many = np.zeros(len(keys), np.int64)
        many[good] = n_groups
        return rows, many, b * both.a.size + a

    def long(both: Aligner, key: tuple, raw: bytes):
        if not all(both.whole([part])[0].all() for part in segments(raw)):
            yield [(*key, 0, 0, 0, "")], np.zeros(1, np.int64), _NONE
            return
        sha, held = hashlib.sha256(), b""
        totals = np.zeros(3, np.int64)
        for part in segments(raw):
            _, n_a, n_b, n_groups, groups, a, b = both.align([part])
            totals += [int(n_a[0]), int(n_b[0]), int(n_groups[0])]
            sha.update(held)
            held = groups[0]
            yield [(*key, 0, 0, 0, "")], n_groups, b * both.a.size + a
        sha.update(held[:-1])
        yield [(*key, *totals.tolist(), sha.hexdigest())], np.zeros(1, np.int64), _NONE

    def run(batches):
        both = aligner(path_a, path_b)
        block = Block(TaskContext.get().partitionId(), both.a.size)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            at, total = 0, 0
            for i, size in enumerate([*sizes, PIECE_BYTES + 1]):
                if i > at and total + size > PIECE_BYTES:
                    raws = pc.fill_null(batch.column(2).slice(at, i - at), "").cast(pa.binary()).to_pylist()
                    for found in long(both, keys[at], raws[0]) if total > PIECE_BYTES else [short(both, keys[at:i], raws)]:
                        block.add(*found)
                        if block.size >= block_links:
                            yield block.pack(stripe_ids)
                    at, total = i, 0
                total += size
        if block.rows:
            yield block.pack(stripe_ids)

    return docs.mapInArrow(tidy(run), _BLOCKS)


def _stripes(batches, width: int):
    """Adds up rows of stripe, data (places in the matrix) and counts, which come by stripe: (stripe, dense counts)."""
    matrix, now = np.zeros(0, np.int64), None
    for batch in batches:
        for stripe, data, counts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("stripe", "data", "counts")), strict=True):
            if stripe != now:
                if now is not None:
                    yield now, matrix
                matrix, now = np.zeros(width, np.int64), stripe
            np.add.at(matrix, np.frombuffer(data, np.uint32), np.frombuffer(counts, np.uint32 if len(data) == len(counts) else np.int64))
    if now is not None:
        yield now, matrix


def _sums(pairs: DataFrame, keys: list[str], slices: int, width: int) -> DataFrame:
    """stripe, data, counts: the sums of the rows of each key, whose first is the stripe."""

    def run(batches):
        for stripe, matrix in _stripes(batches, width):
            at = np.flatnonzero(matrix)
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([matrix[at].tobytes()], pa.binary())], ["stripe", "data", "counts"])

    return pairs.repartition(slices, *keys).sortWithinPartitions(*keys).select("stripe", "data", "counts").mapInArrow(tidy(run), "stripe int, data binary, counts binary")


def pair_scores(pairs: DataFrame, sums: DataFrame, salts: int, slices: int, stripe_ids: int, ids_a: int) -> DataFrame:
    """block, first, data (counts), counts (1 for the best) of each row of pairs: block, stripe, salt, first, data."""

    def run(batches):
        matrix, best, now = None, None, None
        for batch in batches:
            out = [[], [], [], []]
            for stripe, block, first, data, counts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                places = np.frombuffer(data, np.uint32)
                if counts is not None:  # the sums of a stripe come before its rows
                    matrix, now = np.zeros(stripe_ids * ids_a, np.int64), stripe
                    matrix[places] = np.frombuffer(counts, np.int64)
                    grid = matrix.reshape(stripe_ids, ids_a)
                    best = (grid == grid.max(axis=1, keepdims=True)).ravel()
                    continue
                assert stripe == now
                for column, value in zip(out, (block, first, matrix[places].tobytes(), best[places].astype(np.uint8).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "first", "data", "counts"])

    none = F.lit(None)
    many = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.select("stripe", "salt", none.cast("long").alias("block"), none.cast("int").alias("first"), "data", "counts")
    both = many.union(pairs.select("stripe", "salt", "block", "first", "data", none.cast("binary")))
    dealt = both.repartition(slices, "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("counts").isNull())
    return dealt.select("stripe", "block", "first", "data", "counts").mapInArrow(tidy(run), "block long, first int, data binary, counts binary")


def document_scores(docs: DataFrame, scores: DataFrame, slices: int) -> DataFrame:
    """row, n_links, n_best, count_sum of each row of docs, from the scores of its block."""

    def run(batches):
        now, parts, counts, best = None, [], None, None
        for batch in batches:
            out = [[], [], [], []]
            for block, row, first, data, flags in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if block != now:
                    now, parts, counts = block, [], None
                if row is None:
                    parts.append((first, data, flags))
                    continue
                if counts is None:
                    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(d, np.int64) for _, d, _ in sorted(parts))])
                    best = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(f, np.uint8) for _, _, f in sorted(parts))])
                places = np.frombuffer(data, np.uint32)
                for column, value in zip(out, (row, len(places), int(best[places].sum(dtype=np.int64)), int(counts[places].sum())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "n_links", "n_best", "count_sum"])

    none = F.lit(None)
    both = scores.select("block", none.cast("long").alias("row"), "first", "data", "counts").union(docs.select("block", "row", none.cast("int"), "data", none.cast("binary")))
    dealt = both.repartition(slices, "block").sortWithinPartitions("block", F.col("row").isNotNull())
    return dealt.mapInArrow(tidy(run), "row long, n_links long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripe_ids: int = STRIPE_IDS, block_links: int = BLOCK_LINKS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_batches(spark)
    id_col, text_col = quoted([id_col, text_col])
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialize(link_blocks(plain, path_a, path_b, stripe_ids, block_links), "link-blocks")
    ids_a = Tokenizer.from_file(path_a).get_vocab_size()
    sizes = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("size").alias("size"), F.countDistinct("block").alias("blocks")).collect()}
    if not sizes:
        return table.selectExpr("doc_id", "n_a", "n_b", "n_groups", "n_a as n_links", "n_a as n_best", "n_a as count_sum", "groups_sha256")
    pairs_size, blocks = (sizes[1]["size"], sizes[1]["blocks"]) if 1 in sizes else (0, 0)
    salts, slices = max(1, -(-blocks // salt_rows)), slices_for(spark, pairs_size)
    pairs = table.where("kind = 1").select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "first", "data", "counts")
    width = stripe_ids * ids_a
    sums = _sums(pairs, ["stripe", "salt"], slices, width)
    if salts > 1:
        sums = _sums(sums, ["stripe"], slices, width)
    sums = materialize(sums, "pair-counts")
    scores = pair_scores(pairs, sums, salts, slices, stripe_ids, ids_a)
    rows = table.where("kind = 0")
    scored = document_scores(rows, scores, slices_for(spark, sizes[0]["size"] + 2 * pairs_size))
    found = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")])
    none = F.lit(None)
    found = found.union(scored.select("row", none.cast("long"), *[F.lit(0).cast("long")] * 3, none.cast("string"), "n_links", "n_best", "count_sum"))
    out = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")

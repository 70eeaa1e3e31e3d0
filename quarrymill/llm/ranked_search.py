"""Ranked lexical search: the best documents for each item, score at a time over postings grouped by exact impact.

Statistics.  One pass counts documents, terms, and for each term that any item asks for the documents that hold it; a
task sends one row a term.

Search.  A task turns its documents, INDEX_POSTINGS postings at a time, into an index: for each term its distinct impacts,
descending, and the documents of each.  For an item, the impact groups of all its terms are processed in descending order
and added up.  What groups are left bounds what any document can still gain, so the search stops as soon as no document
outside the open ones (whose sum and bound together reach the k-th best so far) can be among the best; their scores
are then completed from all terms they hold.  The k-th best score goes with the task from index to index.  A task gives k rows
an item, and a window over items takes the best of these.

Items are taken in blocks of ITEM_BYTES of text, whose terms alone are broadcast; each block reads the documents twice.

A null or empty item has no terms and no rows, nor have items that no document shares a term with.  A null or empty text has no
terms.  Rows that share an item_id are items of their own; so are documents that share a doc_id; a null doc_id comes first
among equal scores.  Texts of any length count whole, PIECE_BYTES at a time.  Other columns are neither needed nor touched,
whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, quoted, tidy

BEST = 20
#: Postings of one index, bytes of text that are split into terms at a time, and bytes of items in a block.
INDEX_POSTINGS, PIECE_BYTES, ITEM_BYTES = 1_000_000, 1_000_000, 8 << 20
#: Open documents from which completing them costs less than going on.
OPEN = 200
UNIT, LENGTH, DAMP = 1_000_000_000, 25, 12
_NULL = -(1 << 63)
_TERM = np.zeros(256, bool)
_TERM[128:] = True
for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[low : high + 1] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NONE = np.zeros(0, np.int64)


_SPACED = bytes(b if _TERM[b] else 32 for b in _LOWER)


def terms_of(raw: bytes) -> list[bytes]:
    """All terms of a text, repeats included."""
    return raw.translate(_SPACED).split()


class Vocabulary:
    """Numbers of the terms that items ask for.  A term of up to 16 bytes is looked up by these bytes, a longer one by name."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        short = [(t.ljust(16, b"\0"), i) for i, t in enumerate(terms) if len(t) <= 16]
        halves = np.frombuffer(b"".join(t for t, _ in short), "<u8").reshape(-1, 2)
        self.names = {t: i for i, t in enumerate(terms) if len(t) > 16}
        numbers = np.array([i for _, i in short], np.int64)
        order = np.argsort(_place(halves[:, 0], halves[:, 1]), kind="stable")
        self.first, self.second, self.number = halves[order, 0], halves[order, 1], numbers[order]
        self.place = _place(self.first, self.second)
        self.ties = int(np.max(np.diff(np.flatnonzero(np.concatenate([[True], self.place[1:] != self.place[:-1], [True]]))))) if len(order) else 0

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each term of data, -1 for others; data ends in 16 bytes or more that belong to no term."""
        lanes = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        size = end - start
        halves = []
        for k in (0, 8):
            rest = np.clip(size - k, 0, 8)
            cut = np.where(rest < 8, (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            halves.append(lanes[start + k] & cut)
        out = np.full(len(start), -1)
        if len(self.place):
            at = np.searchsorted(self.place, place := _place(*halves))
            for step in range(self.ties):
                here = np.minimum(at + step, len(self.place) - 1)
                same = (self.first[here] == halves[0]) & (self.second[here] == halves[1]) & (self.place[here] == place) & (size <= 16)
                out[same] = self.number[here[same]]
        if self.names:
            raw = data.tobytes()
            for i in np.flatnonzero(size > 16).tolist():
                out[i] = self.names.get(raw[start[i] : end[i]], -1)
        return out


def _place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def term_counts(raws: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats; text, term, times of the terms asked for, by text, then term)."""
    data = np.frombuffer(b"\n".join([*raws, b""]).translate(_LOWER) + bytes(16), np.uint8)
    inside = _TERM[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes + 1)]))
    many = np.diff(first)
    number = vocabulary.numbers(data, start, end)
    known = np.flatnonzero(number >= 0)
    key = np.sort(np.repeat(np.arange(len(raws)), many)[known] * len(vocabulary.terms) + number[known])
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else _NONE
    doc, term = np.divmod(key[at], max(1, len(vocabulary.terms)))
    return many, doc, term, np.diff(np.append(at, len(key)))


def pieces(raw: bytes):
    """A text in parts of about PIECE_BYTES that no term reaches over; a longer term is a part of its own length."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(raw) and _TERM[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def counted(texts: pa.Array, vocabulary: Vocabulary):
    """(first row, and term_counts) of consecutive rows: about PIECE_BYTES together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate([*sizes.tolist(), PIECE_BYTES + 1]):
        if i > at and total + size > PIECE_BYTES:
            raws = pc.fill_null(texts.slice(at, i - at), "").cast(pa.binary()).to_pylist()
            if total <= PIECE_BYTES:
                yield at, *term_counts(raws, vocabulary)
            else:
                many, times = 0, np.zeros(len(vocabulary.terms), np.int64)
                for piece in pieces(raws[0]):
                    n, _, term, count = term_counts([piece], vocabulary)
                    many += int(n[0])
                    times[term] += count
                term = np.flatnonzero(times)
                yield at, np.array([many]), np.zeros(len(term), np.int64), term, times[term]
            at, total = i, 0
        total += size


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Index:
    """Postings of some documents by term and exact impact, and the terms of each document.

    size: number of documents; doc, term, impact: a posting each, in the order of documents.
    """

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.size, self.terms = size, terms
        order = np.lexsort((-impact, term))
        self.docs, t, i = doc[order], term[order], impact[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])])) if len(t) else _NONE
        self.group_impact, self.group_start = i[new], np.append(new, len(t))  # a group: one term, one impact
        self.falling = -self.group_impact
        self.term_group = np.searchsorted(t[new], np.arange(terms + 1))
        self.own, self.own_term, self.own_impact = np.searchsorted(doc, np.arange(size + 1)), term, impact

    def search(self, asked: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of whatever can be among the k best; least: a score that k documents elsewhere reach."""
        at, stop = self.term_group[asked], self.term_group[asked + 1]
        some = at < stop
        held, held_times, at, stop = asked[some], times[some], at[some], stop[some]
        total = np.zeros(self.size, np.int64)
        bound = held_times * self.group_impact[at] if len(at) else _NONE
        while bound.any():
            rest = int(bound.sum())
            if self.size > k:
                least = max(least, int(np.partition(total, self.size - k)[self.size - k]))
            if rest < least:  # whoever has no sum yet is out
                open_ = np.flatnonzero(total + rest >= least)
                if len(open_) <= OPEN:
                    return self.complete(open_, held, held_times)
            level = max(1, int(bound.max()) * 2 // 3)  # the groups from here up are next, whatever their term
            for j in np.flatnonzero(bound >= level).tolist():
                upto = int(at[j]) + int(np.searchsorted(self.falling[at[j] : stop[j]], -(-(-level // int(held_times[j]))), side="right"))
                groups = slice(int(at[j]), upto)
                many = self.group_start[groups.start + 1 : upto + 1] - self.group_start[groups]
                docs = self.docs[self.group_start[groups.start] : self.group_start[upto]]
                total[docs] += np.repeat(held_times[j] * self.group_impact[groups], many)
                at[j], bound[j] = upto, held_times[j] * self.group_impact[upto] if upto < stop[j] else 0
        found = np.flatnonzero(total >= max(1, least))
        return found, total[found]

    def complete(self, docs: np.ndarray, asked: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents with their whole scores, from all terms they hold."""
        wanted = np.zeros(self.terms, np.int64)
        wanted[asked] = times
        many = self.own[docs + 1] - self.own[docs]
        ends = np.cumsum(many)
        at = np.repeat(self.own[docs] - (ends - many), many) + np.arange(many.sum())
        before = np.concatenate([[0], np.cumsum(wanted[self.own_term[at]] * self.own_impact[at])])
        score = before[ends] - before[ends - many]
        return docs[score > 0], score[score > 0]


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best: highest score, then smallest id."""
    rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(ids) > k else np.arange(len(ids))
    return rows[np.lexsort((ids[rows], -score[rows]))[:k]]


def statistics(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and how many documents hold each term of the vocabulary."""

    def run(batches):
        words = vocabulary.value
        many, total, held = 0, 0, np.zeros(len(words.terms), np.int64)
        for batch in batches:
            for _, n, _, term, _ in counted(batch.column(0), words):
                many, total = many + int((n > 0).sum()), total + int(n.sum())
                held += np.bincount(term, minlength=len(held))
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[many, total], held[term]]))], ["term", "n"])

    # a row for each term that this block of items asks for
    rows = docs.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(vocabulary.value.terms))], np.int64)


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task; items: (number, text)."""
    sc = docs.sparkSession.sparkContext
    split = [(number, terms_of(text)) for number, text in items]
    words = sorted({t for _, terms in split for t in terms})
    vocabulary = sc.broadcast(Vocabulary(words))  # of ITEM_BYTES of text
    n, total, held = statistics(docs, vocabulary)
    number = {t: i for i, t in enumerate(words)}
    asked = [(item, *np.unique(np.array([number[t] for t in terms], np.int64), return_counts=True)) for item, terms in split]
    known = sc.broadcast((asked, np.array([weight(n, int(df)) for df in held], np.int64)))

    def run(batches):
        (items, weights), words = known.value, vocabulary.value
        kept = {item: (_NONE, _NONE) for item, _, _ in items}
        parts, size, postings = [], 0, 0

        def search():
            ids, doc, term, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
            index = Index(len(ids), doc, term, impact, len(words.terms))
            for item, term, times in items:
                ids_, score_ = kept[item]
                found, score = index.search(term, times, k, int(score_.min()) if len(score_) == k else 0)
                ids_, score_ = np.concatenate([ids_, ids[found]]), np.concatenate([score_, score])
                rows = best(ids_, score_, k)
                kept[item] = ids_[rows], score_[rows]

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, many, doc, term, times in counted(batch.column(1), words):
                lengths = np.array([75 + LENGTH * x * n // max(1, total) for x in many.tolist()], np.int64)
                impact = weights[term] * ((UNIT * times) // (1000 * times + DAMP * lengths[doc]))
                parts.append((ids[at : at + len(many)], doc + size, term, impact))
                size, postings = size + len(many), postings + len(doc)
                if postings >= INDEX_POSTINGS:
                    search()
                    parts, size, postings = [], 0, 0
        if parts:
            search()
        rows = [(item, *x) for item, found in kept.items() for x in zip(*(c.tolist() for c in found), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [[]] * 3], ["item", "at", "score"])

    # a null doc_id goes as the smallest number there is
    numbered = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("at"), "text")
    return numbered.mapInArrow(tidy(run), "item long, at long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    id_col, text_col, item_col, item_text_col = quoted([id_col, text_col, item_col, item_text_col])
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("asked"))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = -(-int(items.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) // item_bytes)
    found = []
    for b in range(max(1, blocks)):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == b).select("item", "asked").collect()  # some ITEM_BYTES of text
        found.append(_search_block(docs, [(r["item"], bytes(r["asked"])) for r in some], k))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "at"))
    top = reduce(DataFrame.union, found).withColumn("rank", place).where(F.col("rank") <= k)
    doc_id = F.when(F.col("at") != F.lit(_NULL), F.col("at"))
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")

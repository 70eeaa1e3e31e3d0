"""Suffix-array dedup: removes every byte that lies in a MIN_BYTES-long string which also starts earlier in the corpus.

Deal.  Two equal windows of MIN_BYTES bytes have the same smallest K-gram hash at the same place, so each window is dealt
to that K-gram, its anchor.  The windows of one anchor in one text form a span; a span is a row, about one for 35 bytes.

Collapse.  Rows with the same anchor and the same span are the same windows: the earliest stays, the others are removed
whole, first within a batch, then within a slice.  Anchors that are frequent over all documents are dealt window by
window instead, so what many documents share collapses in every batch and no task gets a hot group.  The number of slices
follows the size of the texts.

Sort.  Only anchors with several different spans remain: edges of repeats, where texts begin to differ.  The spans of a
block of such anchors are put in suffix order up to the threshold and turned into a Burrows-Wheeler transform; breadth-first
backward extension of intervals then finds common prefixes by increasing length, and stops at MIN_BYTES: whatever is
not separated by then is a window that occurs again.  An anchor whose spans are more than a block is dealt once more, window
by window; of windows that are all equal a task keeps the earliest alone.

Spans count as equal by two 64-bit hashes, of the anchor and of the span, and those of one anchor can differ in the second
only: with 10^13 spans in groups of up to 10^4 a wrong pair is expected once in 400 such corpora.  What the transform finds
is compared byte by byte.

Texts are UTF-8 bytes, null counts as empty; matches never cross documents.  Earlier means a smaller doc_id, or the same
document and an earlier start.  Rows that share a doc_id are documents of their own, in an order that is kept for the run.
Rows without doc_id lose nothing and make none lose anything.  A text below MIN_BYTES loses nothing; longer
ones count whole: those above CHUNK_BYTES are looked at in overlapping parts, which decide nothing, so a task needs some three
bytes for a byte of its longest text (a row can hold 2 GB).  Ties cannot occur, since places differ.  Other columns are neither needed nor touched,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, lookup_few, materialize, quoted, slices_for, tidy, unique_ids
from .words import Words, blocks, mix

MIN_BYTES, K = 100, 32
#: Entries of the table of frequent anchors, 8 bytes each; and bytes of spans that are sorted at a time.
MAX_FREQUENT, SORT_BYTES = 65_536, 1_000_000
#: Bytes of a text that are looked at together.
CHUNK_BYTES = 2_000_000
_PLACE = 31  # bits of a place in a text
_EMPTY = np.zeros(0, np.int64)


def spans(raws: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, text, first window, windows, anchor's place) of each span, in the order of texts."""
    texts = Words(raws)
    n = len(texts.data)
    windows = np.maximum(0, texts.sizes - MIN_BYTES + 1)
    total = int(windows.sum())
    if not total:
        return texts, _EMPTY, _EMPTY, _EMPTY, _EMPTY
    wide = MIN_BYTES - K + 1
    key = texts.window_hashes() >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(n - K + 1).astype(np.uint64)
    padded = np.full(-(-len(key) // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    doc = np.repeat(np.arange(len(raws)), windows)
    start = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + texts.off[doc]
    place = (np.minimum(behind[start], ahead[start + wide - 1]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    return texts, doc[first], start[first], np.diff(np.append(first, total)), place[first]


def windows_of(texts: pa.Array):
    """(first row, texts, place) of consecutive rows; a text above CHUNK_BYTES comes in parts that overlap by a window less a byte."""
    for at, raws in blocks(texts):
        row = 0
        for i, raw in enumerate([*raws, None]):
            if raw is not None and len(raw) <= CHUNK_BYTES:
                continue
            if i > row:
                yield at + row, raws[row:i], 0
            if raw is not None:
                for start in range(0, len(raw) - MIN_BYTES + 1, CHUNK_BYTES):
                    yield at + i, [raw[start : start + CHUNK_BYTES + MIN_BYTES - 1]], start
            row = i + 1


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """The anchors that occur most often, sorted; a batch leaves out what it has rarely.  It decides speed, not results."""

    def run(batches):
        for batch in batches:
            found = [texts.hashes(place, place + K) for _, raws, _ in windows_of(batch.column(1)) for texts, _, _, _, place in [spans(raws)]]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                some = counts > max(3, batch.num_rows // 1000)
                yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], ["anchor", "n"])

    counted = docs.mapInArrow(tidy(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 30")
    top = counted.orderBy(F.desc("n"), "anchor").limit(MAX_FREQUENT).select("anchor").toPandas()
    return np.sort(top["anchor"].to_numpy(np.int64).view(np.uint64))


def _earliest(keys: tuple, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and start; and where, in that order, a row is the first with its keys."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        # rows of the same place, in repeated rows, are first together
        again = np.flatnonzero(~new & np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1])]))
        for i in again.tolist():
            new[i] = new[i - 1]
    return order, new


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, those that touch joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    high = np.empty(len(end), np.int64)
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    lift = group * (int(end.max()) + 1)
    high = np.maximum.accumulate(end + lift) - lift
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > high[:-1])]))
    return doc[first], start[first], high[np.append(first[1:], len(doc)) - 1]


def deal(docs: DataFrame, frequent: np.ndarray, slices: int) -> DataFrame:
    """Blocks of spans by slice, and ranges that a batch has found itself: kind 0 and 1."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)
    block = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("anchors", "spans", "docs", "starts", "windows"))])

    def run(batches):
        hot = known.value
        for batch in batches:
            parts = []
            ids = batch.column(0).to_numpy()
            for at, raws, part in windows_of(batch.column(1)):
                texts, doc, first, windows, place = spans(raws)
                if not len(doc):
                    continue
                anchor = texts.hashes(place, place + K)
                if len(hot):
                    split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    times = np.where(split, windows, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    doc, first, anchor = np.repeat(doc, times), np.repeat(first, times) + step, np.repeat(anchor, times)
                    windows = np.where(np.repeat(split, times), 1, np.repeat(windows, times))
                    split = np.repeat(split, times)
                span = texts.hashes(first, first + windows + MIN_BYTES - 1)
                if len(hot):
                    anchor = np.where(split, mix(anchor ^ span), anchor)
                parts.append((anchor, span, ids[at + doc], first - texts.off[doc] + part, windows))
            if not parts:
                continue
            anchor, span, doc, start, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, new = _earliest((anchor, span), doc, start)
            gone = order[~new]
            lost = merge(doc[gone], start[gone], start[gone] + windows[gone] + MIN_BYTES - 1)
            keep = order[new]
            to = (mix(anchor[keep]) % np.uint64(slices)).astype(np.int64)
            keep = keep[np.argsort(to, kind="stable")]
            cuts = np.searchsorted(np.sort(to), np.arange(slices + 1))
            columns = (anchor, span, doc, start.astype(np.uint32), windows.astype(np.uint8))
            rows = [(s, 0, *(c[keep[a:b]].tobytes() for c in columns)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            if len(lost[0]):
                rows.append((int(lost[0][0]) % slices, 1, b"", b"", *(x.astype(np.int64).tobytes() for x in lost)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 7, block, strict=True)], schema=block)

    return docs.mapInArrow(tidy(run), "slice int, kind int, anchors binary, spans binary, docs binary, starts binary, windows binary")


def collapse(blocks_: DataFrame, slices: int) -> DataFrame:
    """anchor null: a range to remove; else the earliest row of each span whose anchor has several spans."""

    def rows(anchor, doc, start, end):
        for a in range(0, len(doc), 500_000):
            b = a + 500_000
            yield pa.RecordBatch.from_arrays([pa.nulls(len(doc[a:b]), pa.int64()) if anchor is None else pa.array(anchor[a:b].view(np.int64)), pa.array(doc[a:b]), pa.array(start[a:b].astype(np.int64)), pa.array(end[a:b].astype(np.int64))], ["anchor", "doc_id", "start", "end"])

    def run(batches):
        held = [[], [], [], [], []]
        for batch in batches:
            for kind, *cells in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if kind:
                    yield from rows(None, *(np.frombuffer(x, np.int64) for x in cells[2:]))
                else:
                    for part, cell, form in zip(held, cells, (np.uint64, np.uint64, np.int64, np.uint32, np.uint8), strict=True):
                        part.append(np.frombuffer(cell, form))
        if not held[0]:
            return
        anchor, span, doc, start, windows = (np.concatenate(x) for x in held)
        held.clear()
        order, new = _earliest((anchor, span), doc, start)
        end = start.astype(np.int64) + windows + MIN_BYTES - 1
        gone = order[~new]
        yield from rows(None, *merge(doc[gone], start[gone].astype(np.int64), end[gone]))
        keep = order[new]
        same = anchor[keep][1:] == anchor[keep][:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keep = keep[several]
        yield from rows(anchor[keep], doc[keep], start[keep], end[keep])

    return blocks_.repartition(slices, "slice").mapInArrow(tidy(run), "anchor long, doc_id long, start long, end long")


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of data (a circle) by their next `depth` symbols at least; ties keep any order."""
    n = len(data)
    code = data.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven symbols of nine bits
        key = key << np.uint64(9) | np.roll(code, -k)
    length = 7
    while True:
        order = np.argsort(key, kind="stable")
        if length >= depth:
            return order
        ranks = np.empty(n, np.uint64)
        ranks[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])).astype(np.uint64)
        key = ranks << np.uint64(32) | np.roll(ranks, -length)
        length *= 2


def repeated_prefixes(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether a suffix shares `threshold` symbols with the one before), by interval expansion.

    An interval of the order is all suffixes that begin with one string.  Extending the string to the left by a symbol
    maps the interval's places through the transform; each new interval separates itself from the suffix after it, which
    fixes the common prefix there if it wasn't fixed by a shorter string.  Strings grow by one symbol a round, and only
    intervals that fixed something go on.
    """
    n = len(data)
    order = suffix_order(data, threshold)
    transform = data[order - 1]
    back = np.empty(n, np.int64)  # from a place of the transform to its symbol's place in the order
    back[np.argsort(transform, kind="stable")] = np.arange(n)
    first = data[order]
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(threshold):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        places = back[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]]
        keys = np.sort(owner << 32 | places)
        owner, places = keys >> 32, keys & 0xFFFFFFFF
        begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[places[1:]] != first[places[:-1]])]))
        low, high = places[begin], places[np.append(begin[1:], len(places)) - 1] + 1
        news = open_[high]
        low, high = low[news], high[news]
        open_[high] = False
        if not len(low):
            break
    return order, open_[:n]


def later_windows(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the windows of these spans that occur in an earlier one."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.zeros(int(sizes.sum()), np.uint16)
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    data[:] = joined
    ends = np.cumsum(sizes)
    body = np.ones(len(data), bool)
    body[ends - 1] = False
    data[body] += 1  # 0 only ends a span
    order, same = repeated_prefixes(data, MIN_BYTES)
    row = np.searchsorted(ends, order, side="right")
    group = np.cumsum(~same)
    fits = (order + MIN_BYTES < ends[row]) & (same | np.concatenate([same[1:], [False]]))  # a whole window, and not alone
    order, row, group = order[fits], row[fits], group[fits]
    place = order - (ends - sizes)[row] + start[row]
    by, new = _earliest((group,), doc[row], place)
    gone = by[~new]
    return merge(doc[row][gone], place[gone], place[gone] + MIN_BYTES)


def _cells(lists: pa.ListArray, *fields: str):
    """For each row, arrays of the fields of its structs; empty for null."""
    at, values = lists.offsets.to_numpy(), [lists.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    for i, there in enumerate(lists.is_valid().to_pylist()):
        yield [v[at[i] : at[i + 1]] if there else _EMPTY for v in values]


def compare(docs: DataFrame, mixed: DataFrame, slices: int, sort_bytes: int) -> DataFrame:
    """Ranges among the spans whose anchors have several: their texts are fetched and met by anchor."""
    size = mixed.groupBy("anchor").agg(F.sum(F.col("end") - F.col("start")).alias("size")).where(F.col("size") > sort_bytes)
    mixed = mixed.join(size, "anchor", "left").select("doc_id", "anchor", "start", "end", F.col("size").isNotNull().alias("large"))
    per_doc = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "end", "large")).alias("cuts"))  # no more than a text has spans

    def fetch(batches):
        for batch in batches:
            out = [[], [], [], []]
            cuts = _cells(batch.column(2), "anchor", "start", "end", "large")
            for doc_id, raw, (anchors, starts, ends, large) in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), cuts, strict=True):
                for anchor, start, end, split in zip(anchors.tolist(), starts.tolist(), ends.tolist(), large.tolist(), strict=True):
                    # the windows of a large anchor go by hashes of their own
                    for a, b in [(k, k + MIN_BYTES) for k in range(start, end - MIN_BYTES + 1)] if split else [(start, end)]:
                        name = xxhash.xxh3_64_intdigest(raw[a:b], anchor & 0xFFFFFFFF) - (1 << 63) if split else anchor
                        for column, value in zip(out, (name, doc_id, a, raw[a:b]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "doc_id", "start", "span"])

    def sort(batches):
        held, size = [[], [], [], []], 0

        def flush(upto: int):
            doc, start, texts = np.array(held[1][:upto], np.int64), np.array(held[2][:upto], np.int64), held[3][:upto]
            found = later_windows(doc, start, texts)
            for column in held:
                del column[:upto]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc_id", "start", "end"])

        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                for column, values in zip(held, batch.slice(a, 2000).columns, strict=True):
                    column += values.to_pylist()
                size = sum(map(len, held[3]))
                if size >= sort_bytes:
                    upto = len(held[0])
                    while upto and held[0][upto - 1] == held[0][-1]:
                        upto -= 1
                    if upto:
                        yield flush(upto)
                    elif len(set(map(len, held[3]))) == 1:  # windows of one hash, the earliest first: it stays for what comes
                        first = {}
                        for i, span in enumerate(held[3]):
                            first.setdefault(span, i)
                        earliest = [[column[i] for i in first.values()] for column in held]
                        yield flush(len(held[0]))
                        held[:] = earliest
        if held[0]:
            yield flush(len(held[0]))

    fetched = docs.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "text", "cuts").mapInArrow(tidy(fetch), "anchor long, doc_id long, start long, span binary")
    return fetched.repartition(slices, "anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(tidy(sort), "doc_id long, start long, end long")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep_columns: bool = False, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, what is left; a character
    that lost some of its bytes is left out of that text.  keep_columns: all columns of docs instead, with what is left as text."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = docs.columns
    others = [c for c in names if c != text_col]
    rest = F.struct(*quoted(others)) if keep_columns else F.lit(None).cast("struct<none:int>")
    whole = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    whole = unique_ids(whole, "own_id", "doc_id")
    docs = whole.where("doc_id is not null").select("doc_id", "text")
    slices = slices_for(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0])  # a span of 27 bytes for 35 of text
    found = materialize(collapse(deal(docs, frequent_anchors(docs), slices), slices), "spans")
    ranges = materialize(compare(docs, found.where("anchor is not null"), slices, sort_bytes), "ranges")
    lost = found.where("anchor is null").select("doc_id", "start", "end").union(ranges)
    per_doc = materialize(lost.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("lost")), "lost-ranges")

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for raw, (start, end) in zip(pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), _cells(batch.column(4), "start", "end"), strict=True):
                kept, removed, many, at = [], 0, 0, 0
                if len(start):
                    _, start, end = merge(np.zeros(len(start), np.int64), start, end)
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        kept.append(raw[at:a])
                        removed, many, at = removed + b - a, many + 1, b
                kept = b"".join([*kept, raw[at:]])
                text = kept.decode("utf-8", "ignore") if with_text or keep_columns else ""
                for column, value in zip(out, (len(raw), removed, many, hashlib.sha256(kept).hexdigest(), text), strict=True):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "rest"])

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, rest {whole.schema['rest'].dataType.simpleString()}"
    if keep_columns:  # names may hold anything, so a schema and not a string
        schema = StructType([*StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string").fields, whole.schema["rest"]])
    out = lookup_few(whole.select("own_id", "text", "rest", "doc_id"), per_doc, "doc_id", run, schema)
    if keep_columns:
        return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in names])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else []))

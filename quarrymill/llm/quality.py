"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays that numpy
traverses for a whole batch at once.

Training reads labelled rows only, at most MAX_TRAIN of them: those with the smallest hashes of their doc_id, so the choice
does not depend on partitions.  Rows whose crc32(doc_id as text) mod 3 is 1 are held out.  Everything else (features,
scores) runs over all documents.  Inputs of a score are statistics of the text alone.

Null texts count as empty and get a score like any other.  Without any usable label all scores are 0.5.  Labels that are
null are left out; of several labels of a document, the mean decides.  Rows that share a doc_id are scored one by one; where
it is labelled, the one with the smallest statistics trains, whatever the partitions.  A null doc_id is held out of training.
Texts of any length count whole.  Other columns are neither needed nor touched, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bound_batches, tidy
from .words import Words, blocks, rolling

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, SHRINK = 120, 4, 64, 0.12, 12.0, 2.0
_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": np.isin(_BYTES, [9, 11, 12, 13, 32]),
    "newline": _BYTES == 10,
    "high": _BYTES >= 128,
    "control": (_BYTES < 9) | ((_BYTES > 13) & (_BYTES < 32)) | (_BYTES == 127),
} | {f"byte {c!r}": _BYTES == ord(c) for c in "!?.,;:'\"#*$%&|<>{}[]()@/\\=+-_~^`"}
_MASK = np.stack(list(_CLASSES.values()), axis=1).astype(np.float64)
_WORD_FEATURES = ["words", "chars", "mean word", "deviation of words", "longest word", "one-letter words", "capital words", "words without letters", "distinct words", "commonest word", "entropy", "lines", "mean line", "distinct lines", "lines ending a sentence", "repeated pairs", "words after themselves", "vowels", "chars a word", "distinct bytes", "mean repeat of pairs"]
FEATURES = [*_CLASSES, *_WORD_FEATURES]
_VOWELS = np.isin(_BYTES, [ord(c) for c in "aeiouAEIOU"])


def _runs(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of each distinct key; a key has its text's number above shift."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[at] >> np.uint64(shift)).astype(np.int64), np.diff(np.append(at, len(keys)))


def statistics(raws: list[bytes]) -> np.ndarray:
    """FEATURES of each text, by numpy over all of them."""
    n = len(raws)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words = Words(raws)
    per = lambda doc, weights=None: np.bincount(doc, weights, minlength=n).astype(np.float64)
    owner = np.repeat(np.arange(n), words.sizes + 1)
    counts = np.bincount(owner * 256 + words.data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    counts[:, 10] -= 1  # the newline between texts
    size = np.maximum(1, words.sizes)[:, None]
    shares = counts / size
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(axis=1)
    chars = counts[:, :128].sum(axis=1) + counts[:, 192:].sum(axis=1)
    many = words.counts.astype(np.float64)
    some = np.maximum(1, many)
    length = words.end - words.start
    mean = per(words.doc, length) / some
    longest = np.zeros(n)
    np.maximum.at(longest, words.doc, length)
    before = lambda mask: np.concatenate([[0], np.cumsum(mask[words.data])])
    upper, lower, letter = before(_CLASSES["upper"]), before(_CLASSES["lower"]), before(_CLASSES["upper"] | _CLASSES["lower"] | _CLASSES["high"])
    inside = lambda sums: sums[words.end] - sums[words.start]
    hashes = words.word_hashes()
    shift, low = 40, np.uint64((1 << 40) - 1)
    place = words.doc.astype(np.uint64) << np.uint64(shift)
    kinds, times = _runs(place | (hashes & low), shift)
    commonest = np.zeros(n)
    np.maximum.at(commonest, kinds, times)
    pairs, at = rolling(hashes, words.doc, 2)
    pair_kinds, pair_times = _runs(place[at] | (pairs & low), shift)
    twice = hashes[at] == hashes[at + 1] if len(at) else np.zeros(0, bool)
    start, end, line_doc = words.lines()
    last = np.searchsorted(words.start, end) - 1  # last word that starts before the line's end
    filled = (last >= 0) & (words.start[last] >= start) if len(words.start) else np.zeros(len(start), bool)
    start, end, line_doc, last = start[filled], end[filled], line_doc[filled], last[filled]
    line_kinds, _ = _runs(line_doc.astype(np.uint64) << np.uint64(shift) | (words.hashes(start, end) & low), shift)
    lines = per(line_doc)
    closed = np.isin(words.data[words.end[last] - 1], [33, 46, 63])
    pair_count = np.maximum(1, many - 1)
    columns = [
        np.log1p(many), np.log1p(chars), mean, np.sqrt(np.maximum(0, per(words.doc, length**2) / some - mean**2)), np.log1p(longest), per(words.doc, length == 1) / some, per(words.doc, (inside(upper) > 0) & (inside(lower) == 0)) / some, per(words.doc, inside(letter) == 0) / some, per(kinds) / some, commonest / some, entropy,
        np.log1p(lines), np.log1p(words.sizes / np.maximum(1, lines)), per(line_kinds) / np.maximum(1, lines), per(line_doc, closed) / np.maximum(1, lines),
        per(pair_kinds, pair_times * (pair_times > 1)) / pair_count, per(words.doc[at], twice) / pair_count, shares[:, _VOWELS].sum(axis=1), chars / some, np.log1p((counts > 0).sum(axis=1)), per(words.doc[at]) / np.maximum(1, per(pair_kinds)),
    ]
    return np.column_stack([shares @ _MASK, *columns])


class Trees:
    """Complete binary trees of one depth in arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        tree, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return out + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins, trees grown level by level."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        start = 0.0 if len(y) == 0 else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(start, np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, leaves)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = coded + np.arange(width) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = (node - first)[:, None] * (width * bins) + flat
            size = many * width * bins
            g = np.bincount(place.ravel(), np.repeat(gradient, width), size).reshape(many, width, bins).cumsum(axis=2)
            h = np.bincount(place.ravel(), np.repeat(weight, width), size).reshape(many, width, bins).cumsum(axis=2)
            n = np.bincount(place.ravel(), minlength=size).reshape(many, width, bins).cumsum(axis=2)
            all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(n < MIN_LEAF) | (all_n - n < MIN_LEAF)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for i in range(many):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + i], threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= inner
        leaf[t] = rate * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + SHRINK)
        margin += leaf[t][node]
    return Trees(start, feature, threshold, leaf)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(statistics(raws) for _, raws in blocks(texts))])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Trees:
    """docs: doc_id, text; labels: doc_id, quality."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "quality", "x"])

    # max_rows rows of 12 bytes at most
    rows = docs.join(F.broadcast(usable), "doc_id").select("doc_id", "text", "quality").mapInArrow(tidy(run), "doc_id long, quality int, x binary")
    # of rows that share a doc_id, the one with the smallest statistics
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("least")).select("doc_id", "least.*").toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(b) for b in rows["x"]]) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, keep_columns: str = "") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted; keep_columns: all of docs' columns and the score by that name."""
    bound_batches(docs.sparkSession)
    plain = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    model = train(plain, labels, max_rows)
    known = docs.sparkSession.sparkContext.broadcast(model)  # some tens of kB, whatever the input
    if keep_columns:  # plain names on the way, since those of docs may hold anything
        at, source = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        schema = StructType([*source.schema.fields, StructField("score", DoubleType())])
    else:
        at, source, schema = 1, plain, "doc_id long, score double"

    def run(batches):
        for batch in batches:
            score = pa.array(known.value.score(_matrix(batch.column(at))), pa.float64())
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), score], ["doc_id", "score"])

    out = source.mapInArrow(tidy(run), schema)
    if keep_columns:
        return out.toDF(*docs.columns, keep_columns)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

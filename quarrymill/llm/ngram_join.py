"""N-gram Jaccard join on five-word shingle sets, exact, with count vectors in an R-tree.

Shingles are hashed into groups; a document's point is how many of its shingles fall in each group, and points of
different lengths are folded to the shorter.  The intersection of two sets is at most the sum of the smaller coordinates,
so a pair, or a document and a whole box of an R-tree, whose sum stays below what the similarity needs is dismissed
without its sets.  Surviving pairs are verified on the full sets.

1. Of each set, the rarest shingles are dealt out to buckets: two sets that are similar share one of their
   |x| - ceil(0.8 |x|) + 1 first shingles in any common order.  The order puts frequent shingles last; a bounded table of
   the most frequent ones gives it.  It decides speed, not results.  Equal sets are one node and collapse in the bucket.
2. Buckets that hold the same nodes are one bucket; most of the many buckets of a passage or of a pair go here.
3. In each bucket an R-tree gives the pairs that the bound allows.  They leave as a row a node: the node and the root of
   the tree that those pairs span, never as pairs.  Components over these rows are families; whatever can be similar is
   in one family.
4. The full set of each member is sent once to its family, where an R-tree over finer points gives pairs, best bound
   first.  A pair whose ends are joined already needs no look; the others are verified, and each one that joins two trees
   is a link.  So a family of m sets gives m - 1 links at most, however many of its pairs are similar.
5. Components over the links.

Buckets and families above a bounded size are split into parts, each of which is compared by itself first; so are shingles
that a great many documents deal out.  Then one node of each tree meets those of other parts, round by round, until few
trees join; what is still outside the largest tree of its group meets all parts (`parts.py`).  Nothing is left out by it, and a
group of near copies, which is one tree by then, costs in proportion to its size.

Words are runs of non-white-space; A-Z is lower-cased.  Fewer than five words are one shingle; no words, null included,
are an empty set that links with nothing, its component is its own doc_id.  Rows are documents; rows that share a doc_id
are linked with each other, and so are their partners.  A row without doc_id links as any other but gives a component no
name: component_id is null where no member has a doc_id.  Other columns are neither needed nor touched, whatever their
names; an empty table gives an empty result.  Ties cannot occur: the links alone decide.  Texts of any length are
taken whole.  Hashes have 64 bits for shingles and 128 for sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_filter, discard, materialize, skew_safe_lookup, slices_for, tidy
from .components import components
from .parts import join_parts
from .words import Words, blocks, mix, rolling

WORDS, PERCENT = 5, 80
#: Groups of the R-tree's points, and the most groups of a vector that goes to buckets; children of a box.
GROUPS, MAX_GROUPS, LEAF = 64, 4096, 24
#: Shingles in the table of frequent ones, 20 bytes each.
MAX_FREQUENT = 262_144
#: Documents of a part of a bucket; bytes of sets and documents of a part of a family; documents that deal out one
#: shingle, half of those from which it is split before any bucket is built.
PART_DOCS, PART_BYTES, FAMILY_DOCS, HOT_ENTRIES = 2048, 4 << 20, 4096, 1_000_000
#: Rows, and bytes of vectors, that a task works on at a time.
ROWS, VECTOR_BYTES = 8_000, 16 << 20


def shingle_sets(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all distinct shingles, in the order of texts, then hashes."""
    words = Words(raws, lower=True)
    hashes = words.word_hashes()
    full, at = rolling(hashes, words.doc, WORDS)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WORDS))
    if len(short):
        extra = np.array([_sequence(hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        full, doc = np.concatenate([full, extra]), np.concatenate([doc, short])
    order = np.lexsort((full, doc))
    full, doc = full[order], doc[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], full[new]


def _sequence(hashes: np.ndarray) -> int:
    value = len(hashes)
    for h in hashes.tolist():
        value = (value * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([value], np.uint64))[0])


def set_digests(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set; n: shingles of each, whose hashes follow one another."""
    digest = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
    if len(hashes):
        filled = np.flatnonzero(n)
        for d, salt in zip(digest, (0x243F6A8885A308D3, 0x13198A2E03707344), strict=True):
            d[filled] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), (np.cumsum(n) - n)[filled])
    return digest


def power_of_two(x: np.ndarray) -> np.ndarray:
    return 2 ** np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)


def group_count(n: np.ndarray) -> np.ndarray:
    """Groups of a vector that goes to buckets: a power of two, so that the low bits of a hash name the group at every length."""
    return np.clip(power_of_two(n / 4), GROUPS, MAX_GROUPS)


def fine_group_count(n: np.ndarray) -> np.ndarray:
    """Groups of a vector that stays in a task with its set: some four a shingle, so that the bound is all but exact."""
    return np.maximum(power_of_two(4 * n), GROUPS)


def count_vectors(doc: np.ndarray, hashes: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """Each document's count vector, in the smallest unsigned type that holds its counts."""
    base = np.concatenate([[0], np.cumsum(groups)])
    low = (hashes & (groups[doc] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(base[doc] + low, minlength=int(base[-1]))
    parts = [counts[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
    return [p.astype(np.uint8 if p.max() < 256 else np.uint32) for p in parts]


def read_vector(raw: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == groups else np.uint32)


def fold(vectors: list[np.ndarray], groups: int, kind=np.int64) -> np.ndarray:
    """Count vectors at a common number of groups: entries whose low bits agree are added."""
    out = np.empty((len(vectors), groups), kind)
    for i, v in enumerate(vectors):
        out[i] = v if len(v) == groups else v.reshape(-1, groups).sum(axis=0)
    return out


def needed(a, b):
    """The smallest intersection that makes sets of a and b shingles similar: 100 i >= PERCENT (a + b - i)."""
    return -(-(PERCENT * (a + b)) // (100 + PERCENT))


def bounds(vectors: list[np.ndarray], q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The sum of smaller coordinates of each pair, at the smaller number of groups of the two."""
    out = np.zeros(len(q), np.int64)
    groups = np.fromiter(map(len, vectors), np.int64, len(vectors))
    level = np.minimum(groups[q], groups[e])
    for g in np.unique(level).tolist():
        rows = np.flatnonzero(level == g)
        step = max(1, 4_000_000 // g)
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            names, at = np.unique(np.concatenate([q[some], e[some]]), return_inverse=True)
            matrix = fold([vectors[i] for i in names.tolist()], g, np.uint32 if max(vectors[i].itemsize for i in names.tolist()) > 1 else np.uint16)
            x, y = at[: len(some)], at[len(some) :]
            inner = max(1, 1_000_000 // g)
            for b in range(0, len(some), inner):
                out[some[b : b + inner]] = np.minimum(matrix[x[b : b + inner]], matrix[y[b : b + inner]]).sum(axis=1, dtype=np.int64)
    return out


class RTree:
    """Boxes over points that are sorted by size and the coordinates with the largest spread, LEAF children a box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0), kind="stable")[:3]
        self.order = np.lexsort((*(points[:, s] for s in spread), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low = self.points, self.sizes
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs whose bound allows the similarity."""
        tops = self.levels[-1][0] if self.levels else self.points
        query, node = np.repeat(np.arange(len(points)), len(tops)), np.tile(np.arange(len(tops)), len(points))
        for level in range(len(self.levels) - 1, -2, -1):
            high, low = self.levels[level] if level >= 0 else (self.points, self.sizes)
            keep = [np.zeros(0, np.int64)]
            for a in range(0, len(query), 100_000):
                q, e = query[a : a + 100_000], node[a : a + 100_000]
                bound = np.minimum(points[q], high[e]).sum(axis=1, dtype=np.int64)
                keep.append(a + np.flatnonzero((bound >= needed(sizes[q], low[e])) & (bound * 100 >= PERCENT * sizes[q])))
            keep = np.concatenate(keep)
            query, node = query[keep], node[keep]
            if level >= 0:
                below = len(self.levels[level - 1][0]) if level else len(self.points)
                query, node = np.repeat(query, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                inside = node < below
                query, node = query[inside], node[inside]
        return query, self.order[node]


def tree_pairs(points: np.ndarray, sizes: np.ndarray, queries: int):
    """Pairs of one cell that the R-tree lets through, for so many query rows at a time; each pair once."""
    tree = RTree(points, sizes)
    for a in range(0, len(points), queries):
        q, e = tree.search(points[a : a + queries], sizes[a : a + queries])
        q += a
        yield q[q < e], e[q < e]


def cell_pairs(cell: np.ndarray, points: np.ndarray, sizes: np.ndarray, queries: int = 128):
    """Pairs of rows of the same cell that the bound lets through, in portions; cell numbers ascend.

    A cell of up to a leaf's rows is a single box, whose rows are compared at once with those of all such cells; larger
    cells get a tree each.
    """
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    many = np.diff(np.append(starts, len(cell)))
    small = many <= LEAF
    row = np.repeat(starts + many, many) - np.arange(len(cell)) - 1  # rows of the cell that follow
    row[np.repeat(~small, many)] = 0
    query = np.repeat(np.arange(len(cell)), row)
    entry = np.arange(len(query)) - np.repeat(np.cumsum(row) - row, row) + query + 1
    for a in range(0, len(query), 100_000):
        q, e = query[a : a + 100_000], entry[a : a + 100_000]
        fits = 100 * np.minimum(sizes[q], sizes[e]) >= PERCENT * np.maximum(sizes[q], sizes[e])
        q, e = q[fits], e[fits]
        fits = np.minimum(points[q], points[e]).sum(axis=1, dtype=np.int64) >= needed(sizes[q], sizes[e])
        yield q[fits], e[fits]
    for start, n in zip(starts[~small].tolist(), many[~small].tolist(), strict=True):
        inside = slice(start, start + n)
        for q, e in tree_pairs(points[inside], sizes[inside], queries):
            yield start + q, start + e


def unite(root: np.ndarray, q: np.ndarray, e: np.ndarray) -> None:
    """Joins the trees of each q and e; root: the smallest row of each row's tree, kept so."""
    while len(q):
        a, b = root[q], root[e]
        apart = a != b
        if not apart.any():
            return
        q, e, a, b = q[apart], e[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, the most frequent one last, and their counts over all documents.

    A batch leaves out what it has once, or in less than one in 2,000 of its rows; whatever is more frequent than that
    is counted at every size of the corpus.  The order of the rest is that of their hashes.
    """

    def run(batches):
        for batch in batches:
            parts = [shingle_sets(raws)[1] for _, raws in blocks(batch.column(0))]
            if parts:
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                some = counts > max(1, batch.num_rows // 2000)
                yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(tidy(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).toPandas()
    return top["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy(), top["n"].to_numpy(np.int64)[::-1].copy()


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (shingles), set digests, the shingles that are dealt out, and the count vector."""
    known = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent)))  # MAX_FREQUENT at most

    def run(batches):
        table, ranks = known.value
        for batch in batches:
            for at, raws in blocks(batch.column(1)):
                doc, hashes = shingle_sets(raws)
                many = len(raws)
                n = np.bincount(doc, minlength=many)
                digest = set_digests(hashes, n)
                vectors = [v.tobytes() for v in count_vectors(doc, hashes, group_count(n))]
                rank = np.zeros(len(hashes), np.int64)
                if len(table) and len(hashes):
                    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                    rank = np.where(table[place] == hashes, ranks[place] + 1, 0)
                order = np.lexsort((hashes, rank, doc))
                # sets of up to three shingles are similar to equal ones only
                dealt = np.where(n > 3, n - -(-PERCENT * n // 100) + 1, 0)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                hashes = hashes[order[nth < np.repeat(dealt, n)]]
                ends = np.cumsum(np.minimum(dealt, n)).tolist()
                columns = [batch.column(0).slice(at, many), pa.array(n, pa.int32()), *(pa.array(d.view(np.int64)) for d in digest)]
                columns += [pa.array([hashes[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()), pa.array(vectors, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "dealt", "vector"])

    return docs.mapInArrow(tidy(run), "doc_id long, n int, h1 long, h2 long, dealt binary, vector binary")


def buckets(found: DataFrame, slices: int, frequent: tuple[np.ndarray, np.ndarray], part_docs: int, hot_entries: int) -> DataFrame:
    """Distinct buckets of several sets of similar size, a row a part: b1, b2 (digests of the bucket), part, parts, sets.

    Sets go by their first digest here: 64 bits, and whatever two sets might share one are both looked up by it later.  A
    task deals an entry to the slice of its shingle, packed in arrays.
    """
    block = pa.schema([("slice", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary())])
    hot = frequent[1] >= 2 * hot_entries
    by_hash = np.argsort(frequent[0][hot])
    hot_names, hot_parts = frequent[0][hot][by_hash], -(-frequent[1][hot][by_hash] // hot_entries)

    def deal(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column(1).to_numpy(), return_index=True)[1]))  # equal sets deal once
            dealt = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            if not dealt:
                continue
            times = np.array([len(x) for x in dealt])
            shingle = mix(np.concatenate(dealt) ^ np.uint64(0xA4093822299F31D0))
            size, digest = (np.repeat(batch.column(i).to_numpy(), times) for i in range(2))
            if len(hot_names):
                raw = np.concatenate(dealt)
                at = np.minimum(np.searchsorted(hot_names, raw), len(hot_names) - 1)
                parts = np.where(hot_names[at] == raw, hot_parts[at], 1)
                part = mix(digest.view(np.uint64)) % parts.astype(np.uint64)
                shingle = np.where(parts > 1, mix(shingle ^ (part + np.uint64(1))), shingle)
            to = (shingle >> np.uint64(32)) % np.uint64(slices)
            order = np.lexsort((shingle, to))
            cuts = np.searchsorted(to[order], np.arange(slices + 1).astype(np.uint64))
            packed = [x[order] for x in (shingle.astype(np.uint32), digest, size)]
            rows = [(s, *(x[a:b].tobytes() for x in packed)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 4, block, strict=True)], schema=block)

    def meet(batches):
        held = [[], [], []]
        for batch in batches:
            for part, column, kind in zip(held, batch.columns[1:], (np.uint32, np.int64, np.int32), strict=True):
                part += [np.frombuffer(x, kind) for x in column.to_pylist()]
        if not held[0]:
            return
        key, digest, size = (np.concatenate(x) for x in held)
        held.clear()
        order = np.lexsort((digest, size, key))
        key, digest, size = key[order], digest[order], size[order].astype(np.int64)
        new = np.ones(len(key), bool)  # of equal sets, one
        new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (digest[1:] != digest[:-1])
        key, digest, size = key[new], digest[new], size[new]
        # a bucket ends where the shingle does, or where the next set is too large for all before it
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] * PERCENT > size[:-1] * 100)]))
        many = np.diff(np.append(start, len(key)))
        name = [np.add.reduceat(mix(digest.view(np.uint64) + np.uint64(salt)), start) for salt in (0x452821E638D01377, 0xBE5466CF34E90C6C)]
        keep = np.flatnonzero(many > 1)
        order = keep[np.lexsort((name[1][keep], name[0][keep]))]
        once = np.ones(len(order), bool)
        once[1:] = (name[0][order][1:] != name[0][order][:-1]) | (name[1][order][1:] != name[1][order][:-1])
        rows = []
        for b in order[once].tolist():
            a, parts = int(start[b]), -(-int(many[b]) // part_docs)
            for p in range(parts):
                inside = slice(a + p * part_docs, a + min((p + 1) * part_docs, int(many[b])))
                rows.append((name[0][b].astype(np.int64), name[1][b].astype(np.int64), p, parts, digest[inside].tobytes()))
            if len(rows) >= 4_000:
                yield _bucket_rows(rows)
                rows = []
        yield _bucket_rows(rows)

    rows = found.where("n > 3").select("n", "h1", "dealt")
    dealt = rows.mapInArrow(tidy(deal), "slice int, keys binary, sets binary, sizes binary")
    met = dealt.repartition(slices, "slice").mapInArrow(tidy(meet), "b1 long, b2 long, part int, parts int, sets binary")
    return met.dropDuplicates(["b1", "b2", "part"])


def _bucket_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], ["b1", "b2", "part", "parts", "sets"])


def entries(bucket_rows: DataFrame) -> DataFrame:
    """cell, group, parts, h1: each part's sets; a part is a cell."""

    def run(batches):
        for batch in batches:
            b1, part, parts = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
            cell = np.where(parts > 1, mix(b1.view(np.uint64) + (part + 1).astype(np.uint64)).view(np.int64), b1)
            sets = batch.column(4).to_pylist()
            for a in range(0, len(cell), 100):
                some = [np.frombuffer(x, np.int64) for x in sets[a : a + 100]]
                many = [len(x) for x in some]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c[a : a + 100], many)) for c in (cell, b1, parts)), pa.array(np.concatenate(some))], ["cell", "group", "parts", "h1"])

    return bucket_rows.mapInArrow(tidy(run), "cell long, group long, parts long, h1 long")


def hot_shingles(found: DataFrame, frequent: tuple[np.ndarray, np.ndarray], part_docs: int, hot_entries: int) -> DataFrame:
    """group, parts, h1: the sets of each shingle that `buckets` has split before it saw them."""
    hot = frequent[1] >= 2 * hot_entries
    order = np.argsort(frequent[0][hot])
    names, parts = frequent[0][hot][order], -(-frequent[1][hot][order] // part_docs)

    def run(batches):
        for batch in batches:
            dealt = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not dealt:
                continue
            shingle, h1 = np.concatenate(dealt), np.repeat(batch.column(0).to_numpy(), [len(x) for x in dealt])
            at = np.minimum(np.searchsorted(names, shingle), len(names) - 1)
            is_hot = names[at] == shingle
            yield pa.RecordBatch.from_arrays([pa.array(shingle[is_hot].view(np.int64)), pa.array(parts[at[is_hot]]), pa.array(h1[is_hot])], ["group", "parts", "h1"])

    return found.where("n > 3").select("h1", "dealt").mapInArrow(tidy(run), "group long, parts long, h1 long").distinct() if len(names) else None


def whole_cells(batches, weigh, rows: int, size: int):
    """Tables of whole cells from batches that are sorted by their first column, cut where rows or bytes reach a limit."""
    held, count, total = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count, total = count + batch.num_rows, total + weigh(batch)
        if count >= rows or total >= size:
            table = pa.Table.from_batches(held)
            cells = table.column(0).to_numpy()
            upto = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
            if upto:  # the last cell waits for its rest
                yield table.slice(0, upto)
                held = table.slice(upto).combine_chunks().to_batches()
                count, total = sum(b.num_rows for b in held), sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held)


def relatives(cells: DataFrame) -> DataFrame:
    """a, b: a tree over the nodes of each cell that the bound allows to be similar; cells: cell, node, n, vector."""

    def run(batches):
        for table in whole_cells(batches, lambda b: b.column(3).nbytes, ROWS, VECTOR_BYTES):
            cell, node, n = (table.column(i).to_numpy() for i in range(3))
            sizes = n.astype(np.int64)
            vectors = [read_vector(v, g) for v, g in zip(table.column(3).to_pylist(), group_count(sizes).tolist(), strict=True)]
            root = np.arange(len(cell))
            for q, e in cell_pairs(cell, fold(vectors, GROUPS), sizes):
                open_ = (root[q] != root[e]) & (node[q] != node[e])
                q, e = q[open_], e[open_]
                fine = bounds(vectors, q, e) >= needed(sizes[q], sizes[e])
                q, e = q[fine], e[fine]
                unite(root, q, e)
            at = np.flatnonzero(node[root] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "a long, b long")


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, shingles: the sets of members (node, doc_id, h1, h2)."""

    holds = broadcast_filter(members, F.xxhash64("doc_id"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(holds(batch.column(1).to_numpy().view(np.uint64))))
            for _, raws in blocks(batch.column(0)):
                doc, hashes = shingle_sets(raws)
                n = np.bincount(doc, minlength=len(raws))
                h1, h2 = set_digests(hashes, n)
                cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["h1", "h2", "shingles"])

    sets = docs.select("text", F.xxhash64("doc_id").alias("hashed")).mapInArrow(tidy(run), "h1 long, h2 long, shingles binary")
    return sets.join(members.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "shingles")


def family_links(held: DataFrame) -> DataFrame:
    """a, b: a forest of similar pairs of each cell; held: cell, node, shingles."""

    def run(batches):
        for table in whole_cells(batches, lambda b: b.column(2).nbytes, ROWS, PART_BYTES):
            cell, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column(2).to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            doc, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
            points = np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets])
            vectors = count_vectors(doc, hashes, fine_group_count(sizes))
            root, kept = np.arange(len(sets)), ([], [])
            for q, e in cell_pairs(cell, points, sizes, queries=32):
                apart = root[q] != root[e]
                q, e = q[apart], e[apart]
                bound = bounds(vectors, q, e)
                fine = np.flatnonzero(bound >= needed(sizes[q], sizes[e]))
                for i in fine[np.argsort(-bound[fine], kind="stable")].tolist():
                    a, b = int(q[i]), int(e[i])
                    if root[a] == root[b]:
                        continue
                    both = np.sort(np.concatenate([sets[a], sets[b]]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= PERCENT * (len(both) - common):
                        low, high = sorted((int(root[a]), int(root[b])))
                        root[root == high] = low
                        if node[a] != node[b]:
                            kept[0].append(min(node[a], node[b]))
                            kept[1].append(max(node[a], node[b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in kept], ["a", "b"])

    return held.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_docs: int = PART_DOCS, part_bytes: int = PART_BYTES, family_docs: int = FAMILY_DOCS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = frequent_shingles(docs)
    found = materialize(signatures(docs, frequent[0]).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = found.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("members"))
    classes = materialize(classes, "classes")
    slices = slices_for(spark, found.agg(F.sum(3 * F.length("dealt"))).first()[0])
    bucket_rows = materialize(buckets(found, slices, frequent, part_docs, hot_entries), "buckets")
    placed = entries(bucket_rows)
    nodes = classes.select("node", "h1").join(placed.select("h1").distinct(), "h1", "left_semi")
    points = found.select(F.col("row").alias("node"), "n", "vector").join(nodes, "node")
    near = materialize(relatives(placed.join(points, "h1").select("cell", "node", "n", "vector")).distinct(), "relatives")
    wide, hot = entries(bucket_rows.where("parts > 1")).select("group", "parts", "h1"), hot_shingles(found, frequent, part_docs, hot_entries)
    wide = (wide.union(hot) if hot else wide).join(classes.select("node", "h1"), "h1").select("group", "node", "parts")
    near = join_parts(wide, near, lambda cells: relatives(cells.join(points.select("node", "n", "vector"), "node").select("cell", "node", "n", "vector")))
    families = components(near)
    members = families.join(found.select(F.col("row").alias("node"), "doc_id", "n", "h1", "h2"), "node")
    members = materialize(members, "members")
    size = members.groupBy("label").agg(F.sum("n").alias("shingles"), F.count("*").alias("docs"))
    parts = F.greatest(F.ceil(8 * F.col("shingles") / part_bytes), F.ceil(F.col("docs") / family_docs))
    size = size.select("label", parts.cast("long").alias("parts"), "docs")
    dealt = skew_safe_lookup(members.select("node", "label"), size, ["label"], "docs", members.count(), how="inner")
    cell = F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts"))

    def verify(cells: DataFrame, of: DataFrame) -> DataFrame:
        return family_links(cells.join(full_sets(docs, of), "node").select("cell", "node", "shingles"))

    links = materialize(verify(dealt.select("node", cell.alias("cell")), members), "family-links")
    wide = dealt.where("parts > 1").select(F.col("label").alias("group"), "node", "parts")
    links = join_parts(wide, links, lambda cells: verify(cells, members.join(cells.select("node").distinct(), "node", "left_semi")))
    links = links.union(shared_id_links(found, classes))
    labels = components(links)
    named = classes.join(labels, "node", "left").select("h1", "h2", "members", "first_id", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "named")
    names = named.groupBy("label").agg(F.min("first_id").alias("component"), F.count("*").alias("nodes"))
    named = skew_safe_lookup(named, names, ["label"], "nodes", named.count(), how="inner").select("h1", "h2", "members", "component")
    out = skew_safe_lookup(found.select("doc_id", "n", "h1", "h2"), named, ["h1", "h2"], "members", found.count())
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    discard(bucket_rows, members)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def shared_id_links(found: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links of the sets of rows that share a doc_id."""
    rows = found.where("n > 0 and doc_id is not null").select("doc_id", "h1", "h2")
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    named = rows.join(shared, "doc_id", "left_semi").distinct().join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node")
    first = named.groupBy("doc_id").agg(F.min("node").alias("a"))
    return named.join(first, "doc_id").where("a != node").select("a", F.col("node").alias("b"))

"""Language ID by rank-order profiles: a document's most frequent n-grams against those of each language.

N-grams are runs of one to three characters of a lower-cased word that stands between two blanks; whatever is no letter is
a blank.  A profile is the RANKS most frequent ones in order, equal counts by character.  A document is as far from a
language as its own n-grams are out of place there, at most RANKS each; the nearest language is predicted, of equally near
ones the first by name.  score is the share of the largest possible distance that is left.

Profiles learn from rows with text, lang and doc_id whose crc32(doc_id as text) mod 3 is not 1: of each language from the
MAX_DOCUMENTS doc_ids with the smallest hashes, and of languages from the MAX_LANGUAGES with the most rows.  These two bound
the driver's table and the time of a prediction; all else covers all rows.  Counting runs on Spark; the driver gets at
most MAX_LANGUAGES * RANKS n-grams.

A text that is null, empty or without letters is `und` with score 0, and so is every text if nothing can be learned.  A
row gives a row, whether its doc_id is shared or null (its held_out is then null, and it does not train).  Texts of any length
count whole: they are taken PIECE_BYTES at a time, cut after a space or newline, or where a piece without any ends.  Other
columns are neither needed nor touched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, quoted, tidy
from .quality import held_out

RANKS, MAX_DOCUMENTS, MAX_LANGUAGES = 400, 2_000, 500
PIECE_BYTES = 500_000
UNKNOWN = "und"
_BITS = 21  # of a character in an n-gram
_NONE = np.zeros(0, np.int64)


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter + 1, or 1 if it is none; 1 is the blank."""
    kinds = np.ones(0x110000, np.int64)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            low = c.lower()
            kinds[point] = 1 + (ord(low) if len(low) == 1 else point)
    return kinds


def pieces(raw: bytes):
    """A text in parts of about PIECE_BYTES; where they are cut depends on the text alone."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = max(raw.rfind(b" ", at, at + PIECE_BYTES), raw.rfind(b"\n", at, at + PIECE_BYTES)) + 1
        if end <= at:
            end = at + PIECE_BYTES
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def gram_counts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of some texts, in the order of texts, then n-grams; 21 bits a character name an n-gram."""
    joined = b"\n".join([b"", *raws, b""])
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) + 1
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    symbols = _letters()[points]
    owner = np.repeat(np.arange(len(raws) + 1), np.diff(starts[ends], prepend=1, append=len(points)))
    owner = np.concatenate([[0], owner])[: len(points)]
    letter = symbols > 1
    keep = letter | np.concatenate([[True], letter[:-1]])  # of each run of blanks, one
    symbols, owner, letter = symbols[keep], owner[keep], letter[keep]
    table = np.unique(symbols)
    dense = np.searchsorted(table, symbols) + 1
    table = np.concatenate([[0], table])
    bits = int(len(table)).bit_length()
    two = (dense[:-1] << bits) | dense[1:]
    three = ((two[:-1] << bits) | dense[2:])[letter[1:-1]]
    code = np.concatenate([dense[letter], two, three])
    place = np.concatenate([owner[letter], np.where(letter[:-1], owner[:-1], owner[1:]), owner[1:-1][letter[1:-1]]])
    if 3 * bits + int(len(raws)).bit_length() < 64:
        both = np.sort((place << (3 * bits)) | code)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else _NONE
        place, code, size = both[first] >> (3 * bits), both[first] & ((1 << (3 * bits)) - 1), len(both)
    else:  # a great many different characters at once
        order = np.lexsort((code, place))
        place, code, size = place[order], code[order], len(order)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (code[1:] != code[:-1])])) if size else _NONE
        place, code = place[first], code[first]
    mask = (1 << bits) - 1
    exact = (table[code >> (2 * bits)] << (2 * _BITS)) | (table[(code >> bits) & mask] << _BITS) | table[code & mask]
    return place, exact, np.diff(np.append(first, size))


def long_gram_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one text of any length."""
    code, count = _NONE, _NONE
    for piece in pieces(raw):
        _, more, n = gram_counts([piece])
        code, at = np.unique(np.concatenate([code, more]), return_inverse=True)
        count = np.bincount(at, np.concatenate([count, n]), len(code)).astype(np.int64)
    return np.zeros(len(code), np.int64), code, count


def counted(texts: pa.Array):
    """(first row, rows, text, n-gram, count) of consecutive rows: about PIECE_BYTES together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate([*sizes.tolist(), PIECE_BYTES + 1]):
        if i > at and total + size > PIECE_BYTES:
            raws = pc.fill_null(texts.slice(at, i - at), "").cast(pa.binary()).to_pylist()
            yield at, len(raws), *(long_gram_counts(raws[0]) if total > PIECE_BYTES else gram_counts(raws))
            at, total = i, 0
        total += size


def ranked(doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the RANKS most frequent n-grams of each text, their ranks); rows come by text, then n-gram."""
    order = np.lexsort((-count, doc))
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = rank < RANKS
    return order[keep], rank[keep]


class Profiles:
    """languages: names in order; code: all n-grams of any profile, ascending; rank: of each language, RANKS where absent."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.languages = sorted({name for name, _, _ in rows})
        self.code = np.unique(np.array([code for _, code, _ in rows], np.int64))
        self.rank = np.full((len(self.languages), len(self.code) + 1), RANKS, np.int64)
        number = {name: i for i, name in enumerate(self.languages)}
        for name, code, rank in rows:
            self.rank[number[name], np.searchsorted(self.code, code)] = rank

    def nearest(self, n: int, doc: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of n texts; -1 and 0 where there is none."""
        best, score = np.full(n, -1), np.zeros(n)
        if not len(doc) or not self.languages:
            return best, score
        row, rank = ranked(doc, count)
        doc, code = doc[row], code[row]
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        at = np.where(self.code[at] == code, at, len(self.code))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        apart = np.stack([np.add.reduceat(np.where(own[at] == RANKS, RANKS, np.abs(own[at] - rank)), first) for own in self.rank])
        best[doc[first]] = apart.argmin(axis=0)
        score[doc[first]] = 1 - apart.min(axis=0) / (RANKS * np.diff(np.append(first, len(doc))))
        return best, score


def learn(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """docs: doc_id, text, lang."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64("doc_id"))
    spoken = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    ids = usable.select("lang", "hash").distinct().withColumn("nth", nth).where(F.col("nth") <= max_documents)
    last = ids.groupBy("lang").agg(F.max("hash").alias("last")).join(F.broadcast(spoken), "lang")  # max_languages rows

    def run(batches):
        for batch in batches:
            names = pc.dictionary_encode(batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0))
            number = names.indices.to_numpy()
            for at, rows, doc, code, count in counted(batch.column(1)):
                language = number[at : at + rows][doc]
                order = np.lexsort((code, language))
                language, code, count = language[order], code[order], count[order]
                if len(order):
                    first = np.flatnonzero(np.concatenate([[True], (language[1:] != language[:-1]) | (code[1:] != code[:-1])]))
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(language[first])), pa.array(code[first]), pa.array(np.add.reduceat(count, first))], ["lang", "code", "n"])

    chosen = usable.join(F.broadcast(last), "lang").where("hash <= last").select("lang", "text")
    grams = chosen.mapInArrow(tidy(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = grams.withColumn("place", place).where(F.col("place") <= RANKS).select("lang", "code", (F.col("place") - 1).alias("rank")).collect()
    return Profiles([tuple(r) for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = MAX_DOCUMENTS, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    bound_batches(docs.sparkSession)
    id_col, text_col, lang_col = quoted([id_col, text_col, lang_col])
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = docs.sparkSession.sparkContext.broadcast(learn(plain, max_documents, max_languages))  # bounded as above

    def run(batches):
        profiles = known.value
        names = [*profiles.languages, UNKNOWN]
        for batch in batches:
            for at, rows, doc, code, count in counted(batch.column(1)):
                best, score = profiles.nearest(rows, doc, code, count)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = plain.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

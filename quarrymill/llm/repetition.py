"""Quality rules on repetition: rolling hashes of several n-gram lengths in numpy measure which share of a text's
characters lies inside n-grams that occur again, and inside lines that occur again.

Words are runs of characters that are no ASCII white space.  Hashes of n consecutive words are sums of word hashes times
powers of an odd constant modulo 2^64, extended from n-1 to n words in one step.  Nulls count as empty texts: no words,
base_failed true.  A row gives a row, whether its doc_id is null or shared.  Of n-grams that are equally frequent, the one
with the most characters is the top one.  Texts of any length are measured whole.  Other columns are neither needed nor
touched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import bound_batches, tidy

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Largest share of characters inside duplicated n-grams, by n.
MAX_COVERAGE = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Largest share of characters in the single most frequent n-gram, by n; only for texts of MIN_TOP_WORDS and more.
MAX_TOP = {2: 0.35, 3: 0.30, 4: 0.25}
MIN_TOP_WORDS = 100
#: Largest share of lines, and of characters, in lines that were there before.
MAX_LINES, MAX_LINE_CHARS, MAX_SYMBOLS_A_WORD = 0.40, 0.40, 0.3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, coverage double, top_share double, line_share double"
#: 1 for bytes that start a character.
_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the n-word windows that start at the marked places."""
    steps = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(raw: bytes) -> tuple:
    words = raw.split()
    n = len(words)
    chars = len(raw) if raw.isascii() else int(_FIRST[np.frombuffer(raw, np.uint8)].sum())
    sizes = np.fromiter(map(len, words), np.int64, n) if raw.isascii() else np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
    word_chars = int(sizes.sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup_lines, dup_chars, lines = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if line and line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    repeat_words, coverage, worst, top_share = 0, 0.0, False, 0.0
    if n >= 2:
        with np.errstate(over="ignore"):
            base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
            rolling, ends = base, np.concatenate([[0], np.cumsum(sizes)])
            for k in range(2, max(max(MAX_COVERAGE), WINDOW) + 1):
                if n < k:
                    break
                rolling = rolling[:-1] * _FACTOR + base[k - 1 :]
                if k in MAX_TOP and n >= MIN_TOP_WORDS:
                    values, first, counts = np.unique(rolling, return_index=True, return_counts=True)
                    often = int(counts.max())
                    if often > 1:
                        at = first[counts == often]
                        share = often * int((ends[at + k] - ends[at]).max()) / word_chars
                        top_share = max(top_share, share)
                        worst |= share > MAX_TOP[k]
                elif k in MAX_COVERAGE or k == WINDOW:
                    marks = repeated(rolling)
                    if not marks.any():
                        break  # no longer window is repeated either
                    inside = covered(marks, k, n)
                    if k == WINDOW:
                        repeat_words = int(inside.sum())
                    if k in MAX_COVERAGE:
                        share = float(sizes[inside].sum() / word_chars)
                        coverage = max(coverage, share)
                        worst |= share > MAX_COVERAGE[k]
    line_share = dup_lines / lines if lines else 0.0
    failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    kept = not (failed or worst or line_share > MAX_LINES or (dup_chars > MAX_LINE_CHARS * len(raw)) or symbols > MAX_SYMBOLS_A_WORD * n)
    return n, word_chars, symbols, dup_lines, repeat_words, failed, kept, coverage, min(1.0, top_share), line_share


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, verdicts and the largest shares measured."""

    def run(batches):
        for batch in batches:
            rows = [measure(raw) for raw in pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "coverage", "top_share", "line_share"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({text_col} as string) as text").mapInArrow(tidy(run), _SCHEMA)

"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over each text, and a
shunting-yard parser evaluates expressions of and/or/with.

A text is lower-cased (A-Z) and read as words of letters, digits and non-ASCII characters.  Phrases and tags match where
their words stand consecutively.  Where the tag ``SPDX-License-Identifier`` (its marks may be others) or the word
``license`` is followed by a colon, what follows up to the line's end is read as an expression such as
``(MIT OR Apache-2.0) AND BSD-3-Clause`` or ``GPL-2.0-only WITH Classpath-exception-2.0``.

Labels are names of licences that RESTRICTION knows, alone or with a version; other words give none, nor do exceptions.
The score says how much the terms found restrict use, from 0 (nothing found, or public domain) to 1 (no use without
permission): ``and`` takes the stricter side, ``or`` the freer one, ``with`` relaxes; an expression of unknown names alone
counts for nothing.  An unbalanced expression is read as far as it parses.

Null and empty texts have no words, no labels and the score 0.  A row gives a row, whether its doc_id is null or shared;
texts of any length are read whole; ties cannot occur.  Other columns are neither needed nor touched, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bound_batches, tidy

#: The phrases of the contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases that this scan adds.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "eclipse public license": "epl",
    "released into the public domain": "public-domain",
    "creative commons zero": "cc0-1.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}
#: Words behind which a colon begins an expression.
TAGS = ("spdx license identifier", "license")
#: How much a licence restricts use; by the longest name here that it is a version of, else UNKNOWN.
RESTRICTION = {"public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "apache": 0.15, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.45, "cc-by-sa": 0.5, "gpl": 0.6, "agpl": 0.7, "cc-by-nd": 0.75, "cc-by-nc": 0.8, "proprietary": 1.0}
UNKNOWN, EXCEPTION_FACTOR = 0.5, 0.75
#: Lower case for A-Z; a space for every byte that no word has.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_AFTER_TAG = re.compile(rb"[ \t]*:[ \t]*([^\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def known(name: str) -> str | None:
    """The licence that a name is, or is a version of."""
    fits = [k for k in RESTRICTION if name == k or name.startswith(k) and name[len(k)] in "-+.v0123456789"]
    return max(fits, key=len, default=None)


def restriction(name: str) -> float:
    return RESTRICTION.get(known(name), UNKNOWN)


def parse(expression: str) -> tuple[list[str], float] | None:
    """(licence names, restriction) of an expression, by two stacks; None if there is none at its start.

    A name after a name, or a closing bracket without its opening one, ends the expression.
    """
    values: list[tuple[list[str], float]] = []
    operators: list[str] = []

    def apply() -> None:
        operator = operators.pop()
        (b, y), (a, x) = values.pop(), values.pop()
        if operator == "with":
            values.append((a, x * EXCEPTION_FACTOR))
        else:
            values.append((a + b, max(x, y) if operator == "and" else min(x, y)))

    want_name = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if want_name:
            if token == "(":
                operators.append(token)
            elif token == ")" or word in _PRIORITY:
                break
            else:
                values.append(([word], restriction(word)))
                want_name = False
        elif token == ")":
            while operators and operators[-1] != "(":
                apply()
            if not operators:
                break
            operators.pop()
        elif word in _PRIORITY:
            while operators and operators[-1] != "(" and _PRIORITY[operators[-1]] >= _PRIORITY[word]:
                apply()
            operators.append(word)
            want_name = True
        else:
            break
    if want_name and operators and operators[-1] != "(":
        operators.pop()  # its right side is missing
    while operators:
        if operators[-1] == "(" or len(values) < 2:
            operators.pop()
        else:
            apply()
    return values[-1] if values else None


def automaton(phrases) -> ahocorasick.Automaton:
    """Phrases with a space at each end, as the normalised texts have them."""
    out = ahocorasick.Automaton()
    for phrase in phrases:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan_text(raw: bytes, search) -> tuple:
    plain = raw.translate(_WORDS)
    words = plain.split()
    n_base, first, last, base, noticed, expressed, score = 0, None, None, set(), set(), set(), 0.0
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, ends = None, None
    for end, phrase in search.iter(line):
        if phrase in NOTICE_PHRASES:
            noticed.add(NOTICE_PHRASES[phrase])
            continue
        if phrase in TAGS and b":" not in raw:
            continue
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        word = int(np.searchsorted(starts, end - len(phrase) - 1))
        if phrase in BASE_PHRASES:
            n_base += 1
            first, last = word if first is None else min(first, word), word if last is None else max(last, word)
            base.add(BASE_PHRASES[phrase])
            continue
        if ends is None:
            ends = [m.end() for m in _WORD.finditer(plain)]
        expression = _AFTER_TAG.match(raw, ends[word + phrase.count(" ")])
        found = parse(expression[1].decode("utf-8", "replace")) if expression else None
        names = [name for name in found[0] if known(name)] if found else []
        if names:
            expressed.update(names)
            score = max(score, found[1])
    score = max([score, *map(restriction, base | noticed)])
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | noticed | expressed)), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, places of the base phrases, labels and score."""

    def run(batches):
        search = automaton([*BASE_PHRASES, *NOTICE_PHRASES, *TAGS])
        for batch in batches:
            raws = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            rows = [scan_text(raw, search) for raw in raws]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({text_col} as string) as text").mapInArrow(tidy(run), _SCHEMA)

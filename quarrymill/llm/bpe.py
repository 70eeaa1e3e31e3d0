"""Byte-level BPE through the tokenizers library, over Arrow batches.

A text is cut only where the pre-tokenizer certainly starts a new piece: before a single space or around a single
newline between two characters that neither engine can take for white space.  Every distinct chunk is encoded once per worker and kept in a
bounded cache; the ids of a whole batch are then gathered with numpy.  Texts with other white space or with format
characters are cut by a regular expression at the same places only.

Contract: ids equal ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text.  Null counts as empty.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that either engine may take for white space, and format characters that one of them might.
_SPACES = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
#: Before a single space, before and after a single newline, with certain non-space on both sides; whatever the rest counts
#: as, no piece reaches over these places.
_CUT = re.compile(f"(?<=[^{_SPACES}])(?=[ \\n][^{_SPACES}])|(?<=[^{_SPACES}]\\n)(?=[^{_SPACES}])")
#: A text that matches this needs _CUT; \x01 and \x02 mark chunks below.
_UNUSUAL = r"[ \n][ \n]|[\x01\x02\t\x0b-\x0d\x1c-\x1f]|[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
#: ASCII punctuation; a run of it is one piece, but for the apostrophe, which may start a contraction.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A marked chunk of plain letters or digits; without a mark, a space stands before it.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_PLAIN = rf"^(?:[\x01\x02](?:[{_LETTERS}]*|[0-9]*)|[{_LETTERS}]+|[0-9]+)$"
#: Bounds of the cache of one worker.
MAX_CHUNKS, MAX_CHARS = 300_000, 6_000_000
#: Characters of text that are encoded at a time.
BLOCK_BYTES = 3_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Encoder:
    """encode(texts) -> (ids of all texts, offsets).  tokenizer: of the tokenizers library, byte-level, without normalizer."""

    def __init__(self, tokenizer, specials=()):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pre, self.specials = tokenizer, tokenizer.pre_tokenizer, tuple(specials)
        self.bare = Tokenizer(tokenizer.model)  # takes pieces that are already byte characters, one on a line
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.widths[list(vocab.values())] = [len(t) for t in vocab]
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.space, self.newline = self.chars[32], self.chars[10]
        self.clear()

    def clear(self):
        """Forgets all pieces; piece 0 is the empty one."""
        self.known: dict[str, int] = {"\x02": 0}
        self.flat, self.size, self.held = np.zeros(1 << 20, np.uint32), 0, 0
        self.starts, self.lens = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _put(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.known.update(zip(keys, range(len(self.starts), len(self.starts) + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, self.size + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.size += len(ids)
        self.held += sum(map(len, keys))

    def _learn_words(self, words: list[str]) -> None:
        """Plain words, each one piece of the pre-tokenizer; with the mark \x01 a newline's piece stands before."""
        chars, space, newline = self.chars, self.space, self.newline
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            lines = []
            for w in some:
                mark = w[0]
                body = w[1:] if mark < "\x03" else w
                if not body.isascii():
                    body = body.encode().decode("latin-1").translate(chars)
                lines.append(space + body if mark > "\x02" else body if mark == "\x02" else f"{newline}\n{body}" if body else newline)
            coded = self.bare.encode_batch_fast(["\n".join(lines[i : i + 1000]) for i in range(0, len(lines), 1000)], add_special_tokens=False)
            ids = np.concatenate([np.array(c.ids, np.int64) for c in coded])
            # tokens never reach over a piece, so the lengths of both tell where each word's ids end
            width = np.array([len(x) - ("\n" in x) for x in lines])
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(width)) + 1
            self._put(some, ids, np.diff(ends, prepend=0))

    def _learn_others(self, keys: list[str]) -> None:
        chunks = [key[1:] if key[:1] == "\x02" else "\n" + key[1:] if key[:1] == "\x01" else " " + key for key in keys]
        whole = [any(s in c for s in self.specials) for c in chunks] if self.specials else [False] * len(keys)
        pieces = [[] if w else [p for p, _ in self.pre.pre_tokenize_str(c)] for c, w in zip(chunks, whole, strict=True)]
        lines = [p for some in pieces for p in some]
        coded = self.bare.encode_batch_fast(["\n".join(lines[i : i + 1000]) for i in range(0, len(lines), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(c.ids, np.int64) for c in coded)])
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([sum(map(len, some)) for some in pieces])) + 1
        ends = np.where(np.array([not some for some in pieces]), 0, ends)
        lens = np.diff(np.maximum.accumulate(ends), prepend=0)
        if any(whole):
            parts = np.split(ids, np.cumsum(lens)[:-1])
            parts = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.int64) if w else part for c, w, part in zip(chunks, whole, parts, strict=True)]
            ids, lens = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        self._put(keys, ids, lens)

    def _indices(self, keys: list[str], learn) -> np.ndarray:
        known = self.known
        missing = [k for k in keys if k not in known]
        if missing:
            learn(missing)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _UNUSUAL)
        marked = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), pc.replace_substring(texts, "\n", " \x01"), pa.scalar("", pa.large_string()))
        if pc.any(odd).as_py():
            # their chunks are given as such: no mark \x02 but the one that says "as it stands"
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            pieces = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), marked), " ")
            slow = [["\x02" + c for c in _CUT.split(texts[int(i)].as_py()) if c] for i in rows]
            lists_off = pieces.offsets.to_numpy().astype(np.int64)
            counts = np.diff(lists_off)
            flat = pieces.values.to_pylist()
            at = dict(zip(rows.tolist(), slow, strict=True))
            merged, sizes = [], []
            for i in range(n):
                part = at.get(i)
                part = flat[lists_off[i] : lists_off[i + 1]] if part is None else part
                merged += part
                sizes.append(len(part))
            counts = np.array(sizes, np.int64)
            values = pa.array(merged, pa.large_string())
        else:
            pieces = pc.split_pattern(marked, " ")
            counts, values = np.diff(pieces.offsets.to_numpy().astype(np.int64)), pieces.flatten()
        coded = values.dictionary_encode()
        keys = coded.dictionary
        if len(self.known) > MAX_CHUNKS or self.held > MAX_CHARS:
            self.clear()
        # a chunk is a plain word and a run of punctuation, two pieces at most, or else it is taken as a whole
        words = pc.utf8_rtrim(keys, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        tail = (pc.binary_length(keys).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
        piece = np.zeros((len(keys), 2), np.int64)
        coded_words = words.filter(pa.array(plain)).dictionary_encode()
        piece[plain, 0] = self._indices(coded_words.dictionary.to_pylist(), self._learn_words)[coded_words.indices.to_numpy()]
        rest = np.flatnonzero(plain & (tail > 0))
        piece[rest, 1] = self._indices_of_repeated(["\x02" + k[-t:] for k, t in zip(keys.take(pa.array(rest)).to_pylist(), tail[rest].tolist(), strict=True)])
        rest = np.flatnonzero(~plain)
        piece[rest, 0] = self._indices(keys.take(pa.array(rest)).to_pylist(), self._learn_others)
        at = piece[coded.indices.to_numpy()].ravel()
        starts, lens = self.starts[at], self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]
        bounds = 2 * np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], ends])[bounds]

    def _indices_of_repeated(self, keys: list[str]) -> np.ndarray:
        self._indices(list(dict.fromkeys(keys)), self._learn_others)
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def blocks(self, texts: pa.Array):
        """(first row, ids, offsets) of consecutive rows whose texts have about BLOCK_BYTES together."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
        at = 0
        for rows in np.unique(cut, return_counts=True)[1].tolist() if len(sizes) else []:
            yield at, *self.encode(texts.slice(at, rows))
            at += rows


_ENCODERS: dict = {}


def json_encoder(path: str) -> Encoder:
    """For a tokenizer file of the library; one for each Python worker, which Spark uses again."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _ENCODERS[path] = Encoder(tokenizer, specials)
    return _ENCODERS[path]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_encoder(path: str, pattern: str) -> tuple[Encoder, np.ndarray, np.ndarray]:
    """An encoder from a rank file, and the byte table of its ids: (bytes of all tokens, where the token of an id starts).

    A pair may merge whenever its bytes together are a token, the smallest rank first; so each way to halve a token into
    two tokens becomes a merge, in the order of ranks.
    """
    if (path, pattern) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_characters()
        name = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        _ENCODERS[path, pattern] = Encoder(tokenizer), np.frombuffer(b"".join(tokens), np.uint8), starts
    return _ENCODERS[path, pattern]


def decode(ids: np.ndarray, table: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids and where each id's bytes end; a character may be split over ids, so only the whole is UTF-8."""
    lens = (starts[1:] - starts[:-1])[ids]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts[ids] - (ends - lens), lens) + np.arange(total)], ends

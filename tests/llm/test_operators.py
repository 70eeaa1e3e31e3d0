"""The ten operators against brute force, on random texts and on tables with every awkward case."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarrymill.llm import byte_bpe, common, components, exact_dedup, licenses, line_dedup, ngram_join, packing, quality, repetition, substring_dedup, token_shards  # noqa: E402
from quarrymill.llm.bpe import json_encoder, rank_encoder, read_ranks  # noqa: E402

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lost string, node long, label string, hash long"


def _texts():
    rng = random.Random(7)
    words = ["The", "house", "is", "große", "élan", "under", "the", "MIT", "license", "naïve", "日本", "x", "#", "a|b", "12", "foo.", "bar,"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 8, 30, 60, 200, 400)]
    texts = [None, "", " ", "\n", "\n\n", "\t \r\n", "one", "The MIT License", "Licensed under the MIT license.", "a" * 250, "ab" * 300, "é" * 150]
    texts += base + base[3:6]
    for text in base[4:]:
        parts = text.split(" ")
        for _ in range(5):
            copy = list(parts)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts.append(text.replace(" ", "  \n"))
        texts.append(f"A line that is long enough.\n{text}\n  a LINE that is long enough.\nshort")
    texts.append("A line that is long enough.\nA line that is long enough.")
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 20))) for _ in range(rng.randrange(1, 6))))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t) for i, t in enumerate(texts)]
    random.Random(3).shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns that the operators use inside, too, and nulls in all of them."""
    data = [(i, t, None, "s", len(t or ""), "lost", None, "label", 5) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    return out


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}


#: Spaces, marks, format characters and letters whose neighbourhood decides where a piece ends.
BITS = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "'", ".", "...", "_", ":", "/", "é", "日本", "1", "¼", "<|endoftext|>", "\x00", "\x01", "\x02", "\x1c", "\x85", "\xa0", "\xad", "🙂", "e\u0301", "\r\n", "\u1680", "\u180e", "\u2003", "\u200b", "\u200d", "\u200e", "\u2028", "\u202f", "\u2060", "\u2063", "\u3000", "\ufeff"]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_encoders_match_the_libraries(seed):
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(seed)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(12_500)] + [None, "", " lead", "trail \n", "è_:o_/\u200b"]
    texts += ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    for encoder, want in ((json_encoder(JSON), lambda t, e=Tokenizer.from_file(JSON): e.encode(t, add_special_tokens=False).ids), (rank_encoder(RANKS, PATTERN)[0], lambda t, e=tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}): e.encode_ordinary(t))):
        found, off = encoder.encode(pa.array(texts))
        assert [found[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [want(t or "") for t in texts]


@pytest.mark.parametrize("lengths", [{}, {1024: 5}, {1: 1}, {600: 10, 424: 3, 300: 40, 1: 7}, {i: (i * 7919) % 13 for i in range(1, 1025)}])
def test_plan_fills_bins_without_gaps(lengths):
    lengths = {k: v for k, v in lengths.items() if v}
    bins = collections.defaultdict(list)
    for length, first, last, per, sequence, offset in packing.plan_bins(lengths, 1024):
        for rank in range(first, last + 1):
            bins[sequence + (rank - first) // per].append((offset + (rank - first) % per * length, length))
    assert collections.Counter(length for items in bins.values() for _, length in items) == lengths
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(k * v for k, v in lengths.items())
    assert len(bins) <= max(-(-total // 1024) * 1.23 + 1, 0)


def test_packing(docs, empty, ids):
    found = packing.pack(docs, JSON, with_ids=True).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for key, parts in pieces.items():
        at = 0
        for n, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 1024)
            assert r["ids"] == ids[key][at : at + r["length"]].tolist() and r["ids_crc32"] == zlib.crc32(ids[key][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[key])
    for items in bins.values():
        assert [o for o, _ in sorted(items)] == list(np.cumsum([0, *(n for _, n in sorted(items))])[:-1]) and sum(n for _, n in items) <= 1024
    assert packing.pack(empty, JSON).count() == 0


def test_licenses(docs, empty, rows):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = by_id(licenses.scan(docs))
    for key, text in rows:
        own = words.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            parts = phrase.split()
            hits = [i for i in range(len(own)) if own[i : i + len(parts)] == parts]
            places += hits
            labels |= {label} if hits else set()
        r = found[key]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(own), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None)) and 0 <= r["score"] <= 1
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "names", "score"), [("MIT", ["mit"], 0.1), ("(MIT OR GPL-2.0-only) AND Apache-2.0", ["mit", "gpl-2.0-only", "apache-2.0"], 0.15), ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only"], 0.45), ("MIT AND", ["mit"], 0.1), ("((MIT", ["mit"], 0.1), ("MIT) OR", ["mit"], 0.1), ("MIT OR CC-BY-NC-4.0 AND BSD-3-Clause", ["mit", "cc-by-nc-4.0", "bsd-3-clause"], 0.1)])
def test_expressions(text, names, score):
    found, value = licenses.parse(text)
    assert found == names and value == pytest.approx(score)


def test_expression_without_a_name():
    assert licenses.parse("AND OR") is None and licenses.parse("") is None


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("x\n# SPDX-License-Identifier: GPL-3.0-or-later OR MIT\n", "gpl-3.0-or-later,mit", 0.1),
    ("é SPDX License Identifier : (MIT OR Apache-2.0) AND BSD-3-Clause", "apache-2.0,bsd-3-clause,mit", 0.1),
    ("License: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only", 0.45),
    ("License: see LICENSE\nSPDX-License-Identifier: see notes", "", 0.0),
    ("the license MIT, a mitigation license: mitigation", "", 0.0),
    ("All rights reserved. License: MIT", "mit,proprietary", 1.0),
    *[(phrase.upper().replace(" ", "-"), label, licenses.restriction(label)) for phrase, label in licenses.NOTICE_PHRASES.items()],
])
def test_tagged_text(text, labels, score):
    found = licenses.scan_text(text.encode(), licenses.automaton([*licenses.BASE_PHRASES, *licenses.NOTICE_PHRASES, *licenses.TAGS]))
    assert found[5:] == (labels, pytest.approx(score))


def test_token_shards(docs, empty, ids, tmp_path):
    folder = f"file://{tmp_path}/shards"
    table = common.materialize(token_shards.write(docs, folder, JSON, shard_ids=20_000, shard_keys=12), "manifest")
    manifest = table.collect()
    found = {r["doc_id"]: r for r in token_shards.read(table).collect()}
    assert max(m["n_docs"] for m in manifest) <= 12
    start = 0
    for key in sorted(ids):
        r = found[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[key]), zlib.crc32(ids[key].tobytes()))
        start += len(ids[key])
    assert len(found) == len(ids) and len(manifest) > 1
    readers = [token_shards.ShardReader(m["path"]) for m in manifest]
    for key in list(ids)[::9]:
        hits = [x for r in readers for x in r.lookup(key)]
        assert len(hits) == 1 and hits[0].tolist() == ids[key].tolist()
    assert not [x for r in readers for x in r.lookup(10**9)]
    assert token_shards.write_and_read(empty, JSON).count() == 0


def test_line_dedup(docs, empty, rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held, first = collections.Counter(), {}
    for i, text in sorted(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 10:
                held[k] += 1
                first.setdefault(k, i)
    found = by_id(line_dedup.dedup(docs, with_text=True))
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for x in lines if not (held[key(x)] > 1 and first[key(x)] != i))
        r = found[i]
        dropped = sum(held[key(x)] > 1 and first[key(x)] != i for x in lines)
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"], r["text"]) == (len(lines), dropped, hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_with_a_full_filter(docs, monkeypatch):
    """A filter that is far too small lets nearly all lines through; the result is the same."""
    before = sorted(map(tuple, line_dedup.dedup(docs).collect()))
    monkeypatch.setattr(common, "MAX_FILTER_WORDS", 1)
    assert sorted(map(tuple, line_dedup.dedup(docs).collect())) == before


def test_line_dedup_of_shared_and_missing_ids(spark):
    line = "a line that is long enough"
    rows = [(1, f"{line}\nx"), (1, line), (2, f"{line}\ny"), (None, line), (None, f"{line}\nz"), (3, None)]
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    assert found == [(0, 1, 0, line), (0, 2, 0, f"{line}\nz"), (1, 1, 0, line), (1, 2, 0, f"{line}\nx"), (2, 2, 1, "y"), (3, 1, 0, "")]


def test_line_dedup_filters_lose_no_repeat(monkeypatch):
    """Filters of one bit a hash give false alarms all the time; they may add suspects, but take none away."""

    class Blocks:
        def repartition(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(line_dedup, "BITS_A_KEY", 1)
    hashes = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    often, seldom, marked = hashes[:1000], hashes[1000:2000], hashes[2000:]
    rows = [(0, h.tobytes(), m.tobytes()) for h, m in ((often, marked), (np.concatenate([often, seldom]), marked), (often, marked[:0]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), line_dedup._BLOCK, strict=True)], schema=line_dedup._BLOCK)
    found = [h for b in line_dedup.suspects(Blocks(), 1)(iter([batch])) for h in b.column(0).to_numpy().view(np.uint64).tolist()]
    assert set(found) >= set(often.tolist()) | set(marked.tolist())
    assert len(found) == len(set(found))
    assert not list(line_dedup.suspects(Blocks(), 1)(iter([])))


def test_classifier(spark, docs, empty):
    rng = random.Random(2)
    good = ["The quick brown fox jumps over a lazy dog near the river bank", "Some words make a sentence that people can read without effort"]
    table = [(i, (rng.choice(good) + ". ") * rng.randrange(1, 5) if i % 2 else " | ".join(str(rng.random()) for _ in range(20))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in table] + [(1, None), (10**6, 1)], "doc_id long, quality int")
    data = spark.createDataFrame([*table, (-1, None)], "doc_id long, text string")
    found = by_id(quality.classify(data, labels))
    held = [r for i, r in found.items() if r["held_out"] and i >= 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    assert np.mean([r["predicted"] == i % 2 for i, r in found.items() if r["held_out"] and i >= 0]) > 0.97 and len(held) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert quality.classify(docs, labels.where("false")).where("score = 0.5").count() == docs.count()
    assert quality.classify(empty, labels).count() == 0


def test_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality.fit(x, y, trees=20, depth=3)
    for row, margin in zip(x[:50], trees.margin(x[:50]), strict=True):
        total = trees.start
        for t in range(20):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.leaf[t, node - 7]
        assert total == pytest.approx(margin)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85


def test_byte_bpe(docs, empty, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(byte_bpe.encode_decode(docs, RANKS, PATTERN))
    for i, text in rows:
        want = np.array(tokenizer.encode_ordinary(text or ""), "<u4")
        r = found[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    full = byte_bpe.encode_decode(docs.where("doc_id < 20"), RANKS, PATTERN, full=True).collect()
    assert all(bytes(r["decoded"]) == (dict(rows)[r["doc_id"]] or "").encode() and len(r["ids"]) == len(r["offsets"]) for r in full)
    assert byte_bpe.encode_decode(empty, RANKS, PATTERN).count() == 0


def windows_removed(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                gone[at : at + 100] = True
            seen.add(window)
        out[i] = raw, gone
    return out


def test_substring_dedup(docs, empty, rows):
    found = by_id(substring_dedup.remove(docs))
    for i, (raw, gone) in windows_removed(rows).items():
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), gone.sum(), (np.diff(gone.astype(int), prepend=0) == 1).sum(), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove(empty).count() == 0


def test_substring_dedup_of_a_large_anchor(spark):
    """Spans of one anchor above the size of a block are dealt window by window."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(5, 30))) + passage[rng.randrange(40) : 160 - rng.randrange(10)] + str(i)) for i in range(150)]
    found = by_id(substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sort_bytes=600))
    for i, (raw, gone) in windows_removed(rows).items():
        assert found[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def test_substring_dedup_of_shared_and_missing_ids(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    rows = [(None, a), (None, a), (1, a), (2, "x" + a), (5, b), (5, "y" + b), (5, "clean"), (7, b[:99])]
    out = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    found = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert found[None, a] == 2 and found[1, a] == 1 and found[2, "x"] == 1 and found[5, "clean"] == found[7, b[:99]] == 1
    assert sum(r["n_removed"] for r in out if r["doc_id"] == 5) == 150 and {(5, b), (5, "y" + b)} & set(found)


def test_interval_expansion_finds_all_repeats():
    rng = np.random.default_rng(4)
    for size, symbols, threshold in ((50, 2, 3), (400, 3, 6), (1000, 2, 12), (300, 1, 20)):
        data = rng.integers(1, symbols + 1, size).astype(np.uint16)
        order, same = substring_dedup.repeated_prefixes(data, threshold)
        ring = np.concatenate([data, data])
        keys = [tuple(ring[i : i + threshold]) for i in order]
        assert same.tolist() == [False, *(a == b for a, b in zip(keys[1:], keys[:-1], strict=True))] and sorted(keys) == keys


def _repetition_verdict(text, words, failed):
    """Largest coverage of repeated n-grams, largest share of one n-gram, share of repeated lines, and the verdict, by counting."""
    chars, worst, coverage, top = sum(map(len, words)), failed, 0.0, 0.0
    for n, most in repetition.MAX_COVERAGE.items():
        grams = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        inside = set()
        for k in range(len(words) - n + 1):
            if grams[tuple(words[k : k + n])] > 1:
                inside |= set(range(k, k + n))
        share = sum(len(words[k]) for k in inside) / chars if inside else 0.0
        coverage, worst = max(coverage, share), worst or share > most
    for n, most in repetition.MAX_TOP.items() if len(words) >= repetition.MIN_TOP_WORDS else []:
        grams = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        often = max(grams.values())
        if often > 1:
            share = max(often * sum(map(len, g)) / chars for g, c in grams.items() if c == often)
            top, worst = max(top, share), worst or share > most
    lines = [line for line in text.split("\n") if WORD.search(line)]
    again = [line for k, line in enumerate(lines) if line in lines[:k]]
    share = len(again) / len(lines) if lines else 0.0
    again_bytes = sum(len(x.encode()) for x in again)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    kept = not (worst or share > repetition.MAX_LINES or again_bytes > repetition.MAX_LINE_CHARS * len(text.encode()) or symbols > repetition.MAX_SYMBOLS_A_WORD * len(words))
    return coverage, min(1.0, top), share, kept


def test_repetition(docs, empty, rows):
    found = by_id(repetition.rules(docs))
    for i, text in rows:
        text = text or ""
        words, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = [False] * len(words)
        for k in range(len(words) - 7):
            if grams[tuple(words[k : k + 8])] > 1:
                inside[k : k + 8] = [True] * 8
        failed = len(words) < 20 or 100 * sum(inside) > 30 * len(words)
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(inside), failed)
        assert not (failed and r["kept"])
        assert (r["coverage"], r["top_share"], r["line_share"], r["kept"]) == pytest.approx(_repetition_verdict(text, words, failed)), i
    assert repetition.rules(empty).count() == 0


def sets_and_components(rows):
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


#: Limits that send a few documents the ways of many.
SMALL = {"part_docs": 2, "part_bytes": 3000, "family_docs": 2, "hot_entries": 2}


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_ngram_join(docs, empty, rows, limits):
    found = by_id(ngram_join.link(docs, **limits))
    sets, expected = sets_and_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == {i: (len(sets[i]), expected[i]) for i in sets}
    if not limits:
        assert ngram_join.link(empty).count() == 0


def _near(seed: int, n: int, edits: int) -> list[tuple[int, str]]:
    """Copies of one text with so many words changed: some pairs are similar, others not."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("limits", [{}, {"part_docs": 40, "part_bytes": 20_000, "family_docs": 30, "hot_entries": 25}])
def test_ngram_join_of_a_group_of_near_copies(spark, limits):
    rows = _near(11, 200, 5)
    _, expected = sets_and_components(rows)
    found = by_id(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **limits))
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert 1 < len(set(expected.values())) < 200


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_rows_of_a_group_of_near_copies_grow_with_it(spark, monkeypatch, n):
    """Whatever a step hands on stays in proportion to the group, not to its pairs."""
    counts = {}

    def counted(df, name):
        out = common.materialize(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    found = ngram_join.link(spark.createDataFrame(_near(5, n, 6), "doc_id long, text string"))
    assert found.count() == n
    dealt = 18 * n  # |x| - ceil(0.8 |x|) + 1 of 76 shingles, and some
    assert counts["relatives"] <= 2 * dealt and counts["members"] <= n and counts["family-links"] < n


def test_ngram_join_of_shared_and_missing_ids(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (None, near(b) + " more"), (None, "c d e f g h"), (None, None), (9, None), (7, "a b")]
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0, 0), (0, 2, 0), (0, 57, 2), (2, 56, 2), (3, 56, 2), (5, 56, 2), (5, 56, 2), (7, 1, 7), (9, 0, 9)]


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(5)
    points = rng.poisson(4, (300, ngram_join.GROUPS)).astype(np.uint16)
    points[150:] = points[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.05)
    sizes = points.sum(axis=1).astype(np.int64)
    query, entry = ngram_join.RTree(points, sizes).search(points, sizes)
    found = set(zip(query.tolist(), entry.tolist(), strict=True))
    for a in range(300):
        for b in range(300):
            if np.minimum(points[a], points[b]).sum() >= ngram_join.needed(sizes[a], sizes[b]):
                assert (a, b) in found


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 201)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 201: 200}


@pytest.mark.parametrize("share", [1000, 2])
def test_exact_dedup(docs, empty, rows, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    monkeypatch.setattr(exact_dedup, "SALTS", 3)
    groups = collections.defaultdict(list)
    strip = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    for i, text in rows:
        groups[strip(text)].append((-len(text or ""), i))
    found = by_id(exact_dedup.groups(docs))
    for i, text in rows:
        best = min(groups[strip(text)])[1]
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(groups[strip(text)]), best == i, hashlib.sha256(strip(text).encode()).hexdigest())
    assert exact_dedup.groups(empty).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    rows = [(i, "same  text" if i % 3 else "same text") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    found = by_id(exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(found[i]["keep_id"], found[i]["group_size"]) for i in range(400)} == {(1, 400)}
    assert [i for i, r in found.items() if r["kept"] and i < 1000] == [1] and all(found[1000 + i]["group_size"] == 1 for i in range(50))


def test_exact_dedup_of_a_hot_text_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", 2)
    rows = [(4, "hot text")] * 300 + [(None, "cold")] * 2
    found = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == {(4, 4, 300, True): 1, (4, 4, 300, False): 299, (None, None, 2, True): 1, (None, None, 2, False): 1}


def test_classifier_of_shared_ids(spark):
    """Rows that share a labelled doc_id train as one, and always the same one."""
    rows = [(i % 40, " ".join(f"w{(i * k) % 17}" for k in range(5 + i % 9))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    first, second = (sorted((r["doc_id"], r["score"]) for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).collect()) for n in (1, 7))
    assert len(first) == 400 and first == second


def test_repeated_rows_and_null_keys(spark, tmp_path):
    """No operator fails on repeated rows or on a null doc_id, and none loses a row."""
    text = " ".join(f"w{i}" for i in range(80))
    data = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (2, None)], "doc_id long, text string")
    assert exact_dedup.groups(data).count() == 5
    assert line_dedup.dedup(data).count() == 5
    assert substring_dedup.remove(data).count() == 5
    assert ngram_join.link(data).count() == 5
    assert token_shards.write_and_read(data, JSON).count() == 5
    assert packing.pack(data, JSON).count() == 5
    assert quality.classify(data, data.select("doc_id", F.lit(1).alias("quality"))).count() == 5
    assert byte_bpe.encode_decode(data, RANKS, PATTERN).count() == licenses.scan(data).count() == repetition.rules(data).count() == 5

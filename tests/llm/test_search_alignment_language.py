"""Ranked search, alignment of tokenizers and language ID against brute force, on random texts and awkward tables; hashes of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarrymill.llm import alignment, languages, ngram_join, parts, ranked_search, substring_dedup  # noqa: E402
from quarrymill.llm.bpe import byte_characters  # noqa: E402
from quarrymill.llm.words import Words  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns that the operators use inside, too.
SCHEMA = "doc_id long, text string, lang string, item long, at long, row long, block long, score double, hash long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
VOCABULARY = ["The", "house", "große", "ÉLAN", "a", "b2", "x" * 40, "日本", "of", "the", "mat", "λόγος", "rare", "z9", "thirteenchars", "sixteen_plus_one"]


def _rows(n=150, seed=4):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "...", "<s> ▁ </s>", "a▁b", "<|endoftext|>", "\0", "naïve 日本語 𝒳 　 x", "  two  spaces ", "one", "ONE", "a" * 3000]
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 60))) + rng.choice(["", ".", "\n", "!"]) for _ in range(n)]
    texts += texts[-5:]  # repeated texts: ties
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "xx", None, None, 3, None, None, 7) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_search(rows, items, k):
    terms = [(i, [w.translate(LOWER) for w in TERM.findall(t or "")]) for i, t in rows]
    docs = sum(bool(t) for _, t in terms)
    total = sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        asked = Counter(w.translate(LOWER) for w in TERM.findall(text or ""))
        scores = []
        for i, t in terms:
            tf, score = Counter(t), 0
            for w, times in asked.items():
                if tf[w]:
                    m = 75 + (25 * len(t) * docs) // total
                    score += times * math.floor(1000 * math.log((2 * docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"k": 3, "item_bytes": 60}])
def test_ranked_search(spark, docs, empty, rows, limits, monkeypatch):
    items = [(1, "The house of the rare"), (2, None), (3, ""), (4, "nowhere"), (5, "the THE the große ÉLAN Élan"), (6, "x" * 40 + " 日本 λόγος sixteen_plus_one thirteenchars"), (7, " ".join(VOCABULARY)), (7, "rare")]
    asked = spark.createDataFrame([(*i, 5, 6) for i in items], "item_id long, text string, item long, asked long")
    found = ranked_search.search(docs, asked, **limits)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute_search(rows, items, limits.get("k", 20))
    if not limits:
        assert ranked_search.search(empty, asked).count() == 0 and ranked_search.search(docs, asked.limit(0)).count() == 0


def test_ranked_search_of_shared_and_missing_ids(spark):
    rows = [(5, "red fish"), (5, "red fish"), (None, "red fish"), (2, "red fish"), (9, "blue"), (8, "red " * 30)]
    items = spark.createDataFrame([(None, "red"), (1, "blue red")], "item_id long, text string")
    found = ranked_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items)
    assert Counter(tuple(r) for r in found.collect()) == brute_search(rows, [(None, "red"), (1, "blue red")], 20)


def test_search_of_an_index_stops_early_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(ranked_search, "OPEN", 30)
    rng = np.random.default_rng(3)
    completed = []
    complete = ranked_search.Index.complete
    monkeypatch.setattr(ranked_search.Index, "complete", lambda self, docs, *a: completed.append(len(docs)) or complete(self, docs, *a))
    for _ in range(60):
        size, terms = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        held = np.unique(rng.integers(0, size * terms, int(rng.integers(1, 1500))))
        doc, term = held // terms, held % terms
        impact = rng.choice([0, 1, 5, 5, 40, 300, 301, 5000], len(held)).astype(np.int64)
        index = ranked_search.Index(size, doc, term, impact, terms)
        asked = np.unique(rng.integers(0, terms, 6))
        times = rng.integers(1, 4, len(asked))
        whole = np.zeros(size, np.int64)
        for t, n in zip(asked, times, strict=True):
            np.add.at(whole, doc[term == t], n * impact[term == t])
        k, least = int(rng.integers(1, 9)), int(rng.choice([0, 0, 300]))
        found, score = index.search(asked, times, k, least)
        assert (whole[found] == score).all() and len(set(found.tolist())) == len(found)
        kth = np.sort(whole)[::-1][min(k, size) - 1]
        best = np.flatnonzero((whole >= max(kth, least)) & (whole > 0))
        assert set(best.tolist()) <= set(found.tolist())
    assert completed and max(completed) <= 30


def test_terms_of_long_texts(monkeypatch):
    text = " ".join(["word", "Other", "x" * 30] * 200)
    vocabulary = ranked_search.Vocabulary([b"other", b"x" * 30, b"absent"])
    whole = list(ranked_search.counted(pa.array([None, text, "other"]), vocabulary))
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 100)
    cut = list(ranked_search.counted(pa.array([None, text, "other"]), vocabulary))
    flat = lambda found: [(at + int(d), int(t), int(n)) for at, _, doc, term, times in found for d, t, n in zip(doc, term, times, strict=True)]
    assert flat(whole) == flat(cut) == [(1, 0, 200), (1, 1, 200), (2, 0, 1)]
    assert [int(n) for found in cut for n in found[1]] == [0, 600, 1]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    back, names = {c: i for i, c in enumerate(byte_characters())}, {i: t for t, i in a.get_vocab().items()}
    each, pairs = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(back[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            each.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        groups, links, i, j = [], [], 0, 0
        place = [{end: k + 1 for k, end in enumerate(side)} for side in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            first = i, j
            i, j = place[0][end], place[1][end]
            groups.append((ids_a[first[0] : i], ids_b[first[1] : j]))
            links.append((ids_a[i - 1], ids_b[j - 1]))
        pairs.update(links)
        each.append((len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    out = []
    for found in each:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limits", [{}, {"stripe_ids": 5, "block_links": 300, "salt_rows": 2}])
def test_alignment(docs, empty, rows, limits):
    found = alignment.align(docs, A, B, **limits)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()} == dict(zip([i for i, _ in rows], brute_alignment([t for _, t in rows]), strict=True))
    if not limits:
        assert alignment.align(empty, A, B).count() == 0 and alignment.align(docs.where("text is null"), A, B).select(*COLUMNS).distinct().count() == 1


def test_alignment_of_long_texts(spark, monkeypatch):
    """A text that fills several blocks; one that turns out late not to come back whole; shared and missing ids."""
    rng = random.Random(1)
    long = " ".join(rng.choice(VOCABULARY) for _ in range(3000))
    rows = [(1, long), (1, long + " ▁"), (None, long[:500]), (None, None), (2, "x" * 2000)]
    expected = brute_alignment([t for _, t in rows])
    both = alignment.aligner(A, B)
    monkeypatch.setattr(alignment, "PIECE_BYTES", 700)
    pieces = list(alignment.segments(long.encode()))
    assert len(pieces) > 20 and b" ".join(pieces).decode() == long
    totals, text = np.zeros(3, np.int64), []
    for piece in pieces:
        good, n_a, n_b, n_groups, groups, _, _ = both.align([piece])
        assert good.all()
        totals += [int(n_a[0]), int(n_b[0]), int(n_groups[0])]
        text.append(groups[0])
    assert tuple(totals.tolist()) == expected[0][:3] and hashlib.sha256(b"".join(text)[:-1]).hexdigest() == expected[0][6]
    # the same in a table, whose workers cut at the size of the module
    monkeypatch.undo()
    many = " ".join([long] * 40)
    table = spark.createDataFrame([(1, many), (2, many + " ▁"), (2, "a b"), (None, long)], "doc_id long, text string").repartition(1)
    found = alignment.align(table, A, B, block_links=20_000)
    assert Counter(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in found.collect()) == Counter((i, *x) for i, x in zip([1, 2, 2, None], brute_alignment([many, many + " ▁", "a b", long]), strict=True))


def grams(text):
    out = Counter()
    for word in "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split():
        for n in (1, 2, 3):
            for i in range(len(word) + 3 - n):
                gram = f" {word} "[i : i + n]
                if gram != " " and not (n == 3 and gram[1] == " "):
                    out[gram] += 1
    return out


def brute_languages(rows):
    code = lambda g: sum((1 if c == " " else ord(c) + 1) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    order = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: languages.RANKS]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = {}
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and not held(i):
            counts.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: n for n, g in enumerate(order(c))} for lang, c in counts.items() if c}
    out = {}
    for i, text, _ in rows:
        own = order(grams(text or ""))
        if not own or not profiles:
            out[i] = (held(i), "und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - n) if g in p else languages.RANKS for n, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out[i] = (held(i), best, 1 - apart[best] / (languages.RANKS * len(own)))
    return out


def _speech():
    rng = random.Random(8)
    kinds = {"de": "der die das und nicht über große schön ich bin".split(), "en": "the and of to in is that it was for".split(), "el": "και το να του η ότι λόγος".split(), "ja": ["日本", "語", "テスト", "です"]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(3, 60))), rng.choice([lang, lang, None])) for i in range(240) for lang in [rng.choice(list(kinds))]]
    return rows + [(900, None, "de"), (901, "", "de"), (902, "123 ... !", "en"), (903, "İstanbul ẞ ﬁ", None), (904, "x", "zz"), (905, "日本 the und", None)]


def test_languages(spark, empty):
    rows = _speech()
    table = spark.createDataFrame([(i, t, lang, i) for i, t, lang in rows], "doc_id long, text string, lang string, hash long").repartition(4)
    expected = brute_languages(rows)
    found = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in languages.identify(table).collect()}
    assert found == {i: (h, lang, round(s, 9)) for i, (h, lang, s) in expected.items()}
    told = {i: lang for i, _, lang in rows if i < 900 and lang}
    assert np.mean([found[i][1] == lang for i, lang in told.items() if found[i][0]]) > 0.97
    assert languages.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "the", None), (None, "the", "en"), (1, None, "en")], "doc_id long, text string, lang string")
    assert sorted((r["held_out"] is None, r["lang_pred"], r["score"]) for r in languages.identify(nothing).collect()) == [(False, "und", 0.0), (False, "und", 0.0), (True, "und", 0.0)]


def test_languages_bound_what_they_learn_from(spark):
    rows = [(i, "aaa", "a") for i in range(60)] + [(1000 + i, "bbb", "b") for i in range(40)] + [(2000, "ccc", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = table.select("doc_id", "text", "lang")
    assert languages.learn(plain, max_documents=3, max_languages=2).languages == ["a", "b"]
    assert languages.learn(plain, max_documents=1).languages[:2] == ["a", "b"]


@pytest.mark.parametrize("text", ["the große 日本 " * 4000, "x" * 9000, "é" * 4000 + " a " + "b" * 3000])
def test_long_texts_count_whole(monkeypatch, text):
    monkeypatch.setattr(languages, "PIECE_BYTES", 1000)
    parts_ = list(languages.pieces(text.encode()))
    assert b"".join(parts_).decode() == text and max(map(len, parts_)) <= 1000
    _, code, count = languages.long_gram_counts(text.encode())
    expected = Counter()
    for piece in parts_:
        _, c, n = languages.gram_counts([piece])
        expected.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
    assert dict(zip(code.tolist(), count.tolist(), strict=True)) == expected
    if " " in text[:20]:
        _, whole, n = languages.gram_counts([text.encode()])
        assert dict(zip(whole.tolist(), n.tolist(), strict=True)) == expected


def _thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("n", [8, 16, 32, 64, 1024, 2048, 8192])
def test_patterns_of_bytes_do_not_collide(n):
    word = _thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    first, second, third = Words([word.encode(), other.encode(), word.encode()]).word_hashes().tolist()
    assert first == third != second
    assert Words([b"ab", b"a b", b"ab\0"]).hashes(np.array([0, 3, 7]), np.array([2, 6, 10])).tolist() == [*dict.fromkeys(Words([b"ab", b"a b", b"ab\0"]).hashes(np.array([0, 3, 7]), np.array([2, 6, 10])).tolist())]


def test_words_of_opposite_patterns_are_not_linked(spark):
    rows = [(10 * k + i, w) for k, n in enumerate((1024, 2048, 8192)) for i, w in enumerate((_thue_morse(n), _thue_morse(n).translate(str.maketrans("ab", "ba"))))]
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found) and len(found) == 6


def test_window_hashes_tell_windows_apart():
    raws = [bytes(np.random.default_rng(i).integers(97, 100, 400, dtype=np.uint8)) for i in range(4)] + [_thue_morse(256).encode()]
    words = Words(raws)
    windows = [bytes(words.data[i : i + 32]) for i in range(len(words.data) - 31)]
    assert len(set(zip(windows, words.window_hashes().tolist(), strict=True))) == len(set(windows)) == len(set(words.window_hashes().tolist()))


def test_long_texts_lose_the_same_bytes_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(300))
    long = "".join(rng.choice("abcdef ") for _ in range(4000))
    rows = [(1, long[:1500] + passage + long[1500:]), (2, passage + long[1000:3000]), (3, "q" * 700)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, substring_dedup.remove(table).collect()))
    for chunk in (150, 777):
        seen = []
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
        texts = pa.array([t for _, t in rows])
        for row, raws, part in substring_dedup.windows_of(texts):
            words, doc, first, windows, place = substring_dedup.spans(raws)
            for d, f, n in zip(doc.tolist(), first.tolist(), windows.tolist(), strict=True):
                start = f - int(words.off[d]) + part
                seen += [(row + d, s) for s in range(start, start + n)]
        assert sorted(seen) == [(i, s) for i, (_, t) in enumerate(rows) for s in range(len(t) - 99)]
    assert expected[1][2] > 2000 and expected[2][2] == 699


def test_parts_join_as_if_whole(spark):
    """Trees of parts and what stands outside them: every pair that compare would link comes together, whatever the parts."""
    rng = random.Random(6)
    value = {i: rng.randrange(40) for i in range(300)}

    def compare(cells):
        from pyspark.sql import functions as F

        values = spark.createDataFrame(list(value.items()), "node long, v long")
        rows = cells.join(values, "node")
        other = rows.select("cell", rows["node"].alias("b"), (F.col("v")).alias("w"))
        return rows.join(other, "cell").where("node < b and abs(v - w) <= 1 and v <> 20 and w <> 20").select(rows["node"].alias("b"), "b").toDF("a", "b")

    members = spark.createDataFrame([(1, i, 10) for i in value], "group long, node long, parts long")
    from pyspark.sql import functions as F

    from quarrymill.llm.common import materialize
    from quarrymill.llm.components import components

    first = materialize(compare(members.select(F.pmod("node", F.lit(10)).alias("cell"), "node")), "first")
    links = parts.join_parts(members, first, compare)
    found = {r["node"]: r["label"] for r in components(links).collect()}
    whole = {r["node"]: r["label"] for r in components(materialize(compare(members.select(F.lit(1).alias("cell"), "node")), "whole")).collect()}
    assert found == whole and len(set(whole.values())) >= 2

"""Closures, terms in texts, spelling, JSON trees, page elements, stored tables, providers and timed streams by themselves."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarrymill.operators import closure, html_nodes, json_tree, page_people, term_search
from quarrymill.sources import providers
from quarrymill.sources.staging import new_folder
from quarrymill.sources.stored import StoredTable
from quarrymill.streaming import timers


def test_closure_ends_in_circles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (4, 4), (None, 1), (9, None), (3, 2)], "child long, parent long")
    seeds = spark.createDataFrame([("a", 1), ("b", 4), ("b", 4), (None, 1), ("c", 77)], "root string, node long")
    found = sorted(map(tuple, closure.closure(edges, seeds).collect()))
    assert found == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 4, 0), ("c", 77, 0)]
    assert closure.closure(edges, seeds, rounds=1).count() == 4
    assert closure.closure(edges, seeds.limit(0)).count() == 0


def test_mentions_against_a_nested_loop(spark):
    rng = random.Random(2)
    vocabulary = ["The", "cat", "sat", "on", "the", "mat", "élan", "C++", "a-b", "x"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, None), (501, ""), (502, "a a a a")]
    terms = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [("none", None), ("blank", "!!"), ("twice", "a a"), ("absent", "cat dog")]
    clean = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    expected = {}
    for i, text in texts:
        for name, term in terms:
            whole, part = f" {clean(text)} ", f" {clean(term)} "
            if part.strip() and part in whole:
                expected[i, name] = sum(whole.startswith(part, k) for k in range(len(whole)))
    found = term_search.mentions(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(terms, "term_id string, term string"))
    assert {(r["text_id"], r["term_id"]): r["times"] for r in found.collect()} == expected and len(expected) > 100


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_spelling_misses_no_name(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 8))) for _ in range(150)} | {"Finance", "Health"})
    typed = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))) for i in range(150)] + [(900, " helth "), (901, "FINENCE"), (902, None)]
    expected = {}
    for i, word in typed:
        low = (word or "").strip().lower()
        best = min(((_distance(low, n.lower()), n) for n in names if n.lower()[:2] == low[:2]), default=(9, "")) if len(low) >= 3 else (9, "")
        if best[0] <= 2:
            expected[i] = (best[1], best[0])
    found = term_search.spelled(spark.createDataFrame(typed, "typed_id long, typed string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["typed_id"]: (r["name"], r["distance"]) for r in found.collect()} == expected
    assert expected[900] == ("Health", 1) and expected[901] == ("Finance", 1)


def test_json_of_any_depth(spark):
    deep = {"a": [1, {"b.c": None, "@type": ["X", "Org"], "n": "x"}, [[True]]], "e": {}, "@type": "Org"}
    nodes = json_tree.json_nodes(spark.createDataFrame([(1, json.dumps(deep)), (2, "{broken"), (3, None), (4, "[]")], "id long, json string"))
    rows = {(r["id"], r["path"]): (r["kind"], r["depth"]) for r in nodes.collect()}
    assert rows[1, "$.a[1]['b.c']"] == ("null", 3) and rows[1, "$.a[2][0][0]"] == ("boolean", 4) and rows[1, "$.e"] == ("object", 1)
    assert rows[4, "$"] == ("array", 0) and not any(i in (2, 3) for i, _ in rows)
    typed = {r["path"]: r["fields"] for r in json_tree.typed_nodes(nodes, "^Org$").collect()}
    assert set(typed) == {"$", "$.a[1]"} and typed["$.a[1]"]["n"] == '"x"'


@pytest.mark.parametrize(
    "html, tags",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul(li li(ul(li)) li)"),
        ("<p>a<p>b<div>c</div>", "p p div"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "table(tr(td td) tr(th))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt dd dt)"),
        ("<div><b>x</div></b>y<br/>z<!-- <i> --><script>'<p>'</script>", "div(b) br script"),
        ("<a href='x>y' class=q>t</a", "a"),
        ("", ""),
    ],
)
def test_elements_nest_as_html_says(html, tags):
    rows = html_nodes.elements(html)

    def shown(parent):
        return " ".join(r[3] + (f"({inner})" if (inner := shown(r[0])) else "") for r in rows if r[1] == parent)

    assert shown(0) == tags
    assert all([s[0] for s in r[5]][-1:] == [r[0]] and (len(r[5]) < 2 or r[5][-2][0] == r[1]) for r in rows[1:])


def test_text_and_attributes_of_elements():
    rows = html_nodes.elements("<title>A &amp; B</title><div CLASS='x y' id=k>one <b>two</b>\n<style>p{}</style>&lt;3</div>")
    assert [r[6] for r in rows] == ["A & Bone two\n<3", "A & B", "one two\n<3", "two", ""] and rows[2][4] == {"class": "x y", "id": "k"} and rows[4][7] == "p{}"
    deep = html_nodes.elements("<div>" * 2000 + "x")
    assert len(deep) == 2001 and max(len(r[5]) for r in deep) == html_nodes.MAX_DEPTH + 1


def test_people_of_no_pages(spark):
    none = spark.createDataFrame([], "page long, html string, url string")
    assert page_people.people(none).count() == 0 and page_people.metadata(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "plain text", "https://a.example/team")], "page long, html string, url string")
    assert [tuple(r) for r in page_people.people(blank).orderBy("page").collect()] == [(1, []), (2, []), (3, [])]


def test_people_named_late_in_a_long_text(spark):
    """Running text is read to its end: a person across its 12,000th character, and one 200,000 behind."""
    html = f"<body><div>{'some text ' * 1_199}Ann Poe, Managing Director. {'some text ' * 20_000}Bob Roe, CTO left.</div></body>"
    pages = spark.createDataFrame([(1, html, "https://a.example/news/1")], "page long, html string, url string")
    assert [(p["name"], p["title"]) for p in page_people.people(pages).head()["people"]] == [("Ann Poe", "Managing Director"), ("Bob Roe", "CTO")]


def test_stored_table_keeps_whole_versions(spark, monkeypatch):
    table = StoredTable(spark, new_folder(spark, "stored"), ["k"])
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string, seen string")
    table.create(rows([(i, "old", "first") for i in range(40)]), buckets=8)
    before = table._manifest()
    rejected = table.upsert(rows([(1, "new", "x"), (100, "new", "x"), (None, "lost", "x"), (2, "a", "x"), (2, "b", "x"), (3, "same", "x"), (3, "same", "x")]), kept=["seen"])
    assert sorted((r["k"] or 0, r["reason"]) for r in rejected.collect()) == [(0, "no key"), (2, "several changes of a key"), (2, "several changes of a key")]
    held = {r["k"]: (r["v"], r["seen"]) for r in table.read().collect()}
    assert len(held) == 41 and held[1] == ("new", "first") and held[100] == ("new", "x") and held[2] == ("old", "first") and held[3] == ("same", "first")
    after = table._manifest()
    changed = [b for b in after["files"] if after["files"][b] != before["files"].get(b)]
    assert after["version"] == 1 and 1 <= len(changed) <= 3  # only buckets of the changed keys are written
    # a run that fails before its manifest leaves the version that was there; repeated, it gives one more
    monkeypatch.setattr(StoredTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(rows([(1, "newer", "x")]), kept=["seen"])
    monkeypatch.undo()
    assert table._manifest() == after
    table.upsert(rows([(1, "newer", "x")]), kept=["seen"])
    assert {r["k"]: r["v"] for r in table.read().collect()}[1] == "newer" and table._manifest()["version"] == 2
    # two runs from one version: the second is told so
    with pytest.raises(RuntimeError):
        table._write(rows([(1, "late", "x")]), [0], after)
    assert StoredTable(spark, table.path, ["k"]).read().count() == 41
    with pytest.raises(ValueError):
        StoredTable(spark, new_folder(spark, "nothing"), ["k"]).read()


def test_provider_reads_row_groups_that_may_hold(spark, tmp_path):
    pq.write_table(pa.table({"k": list(range(100)), "v": [f"v{i % 7}" for i in range(100)], "w": [None if i % 2 else i for i in range(100)]}), tmp_path / "t.parquet", row_group_size=10)
    source = providers.provider({"provider": " STORE ", "path": str(tmp_path), "store_key": "x"})
    rows = source.rows(spark)
    assert rows.rdd.getNumPartitions() == 10
    some = rows.where("k >= 25 and k < 41 and v in ('v1', 'v2') and w is not null").select("k", "v")
    assert some.rdd.getNumPartitions() == 3
    assert sorted(r["k"] for r in some.collect()) == [i for i in range(25, 41) if i % 7 in (1, 2) and i % 2 == 0]
    reader = providers.RowGroupReader(str(tmp_path), ["k"])
    assert list(reader.pushFilters([providers.EqualTo(("k",), 55), providers.LessThan(("w",), 3)])) == [] and len(reader.partitions()) == 0
    assert isinstance(providers.provider({"provider": "store", "path": "p"}), providers.Table)
    assert isinstance(providers.provider({"provider": "unheard of", "path": "p"}), providers.Table)
    with pytest.raises(ValueError):
        providers.provider({})


def _stream(spark, place, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(place))


def _files(spark, place, parts, schema):
    """A file a batch, in order."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(place))
        last = max(place.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        stamp = 1_700_000_000 + n
        import os

        os.utime(last, (stamp, stamp))


def test_follow_ups_of_out_of_order_and_late_rows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    h = lambda n: t + timedelta(hours=n)
    schema = "kind string, person string, mail_id long, at timestamp"
    parts = [
        [("r", "a", None, h(2)), ("m", "b", 2, h(0))],  # a's reply comes before the mail that it answers
        [("m", "a", 1, h(1)), ("m", "a", 3, h(3)), (None, "a", 9, None)],
        [("r", "b", None, h(5)), ("m", "c", 4, h(9))],  # b replies after the wait of three hours
        [("r", "b", None, h(1)), ("m", "c", 5, h(30))],  # far behind the watermark: dropped
        [("m", "d", 6, h(40))],
    ]
    _files(spark, tmp_path / "in", parts, schema)
    rows = _stream(spark, tmp_path / "in", schema)
    out = timers.follow_ups(rows.where("kind = 'm'"), rows.where("kind = 'r'"), 3 * 3_600_000)
    query = out.writeStream.format("memory").queryName("follow_ups").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted(tuple(r) for r in spark.table("follow_ups").collect())
    assert found == [("a", 1, "cancelled", h(2)), ("a", 3, "due", h(6)), ("b", 2, "due", h(3)), ("c", 4, "due", h(12)), ("c", 5, "due", h(33))]
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert kept[-1] <= 4  # d's mail, and what goes with it: state does not grow with the stream


def test_expiries_and_new_keys(spark, tmp_path):
    t = datetime(2024, 1, 1)
    h = lambda n: t + timedelta(hours=n)
    schema = "key string, entry long, at timestamp"
    parts = [[("a", 2, h(2)), ("a", 1, h(1)), ("b", 3, h(1))], [("b", 4, h(9)), ("a", 5, h(2))], [("c", 6, h(40)), (None, 1, h(40))]]
    _files(spark, tmp_path / "in", parts, schema)
    out = timers.run_once(timers.expiries(_stream(spark, tmp_path / "in", schema), 3 * 3_600_000), f"file://{tmp_path}/run", "key string, entry long, expired_at timestamp")
    assert sorted(map(tuple, out.collect())) == [("a", 5, h(5)), ("b", 3, h(4)), ("b", 4, h(12))]
    known = spark.createDataFrame([("b",)], "key string")
    fresh = timers.new_keys(_stream(spark, tmp_path / "in", schema), known, ["key"], "at", "20 hours").select("key")
    keys = timers.run_once(fresh, f"file://{tmp_path}/keys", "key string")
    assert sorted(str(r["key"]) for r in keys.collect()) == ["None", "a", "c"]


def test_new_folder_needs_a_shared_one(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")


@pytest.mark.parametrize(
    "text, keywords, fits",
    [
        ("we sell anything", [], True), ("we sell anything", None, True), ("we sell anything", [" ", ""], True),
        ("an it services firm", ["Software"], True), ("an it services firm", ["software", "B2B"], True), ("an it services firm", ["b2b"], False),
        ("a telehealth firm", ["healthtech", "clinical"], True), ("a telehealth firm", ["healthtech", "robots"], False), ("a bakery", ["healthtech", "medical"], False),
        ("robots and arms", ["robots", "arms"], True), ("robots", ["robots", "arms"], False), (None, ["robots"], None),
    ],
)
def test_keywords_of_a_search(spark, text, keywords, fits):
    from pyspark.sql import functions as F

    from quarrymill.functions.search_lists import keywords_match

    df = spark.createDataFrame([(text, keywords)], "text string, keywords array<string>")
    assert df.select(keywords_match(F.col("text"), F.col("keywords"))).first()[0] == fits


def test_exclusions_of_a_search(spark):
    from pyspark.sql import functions as F

    from quarrymill.functions.search_lists import excluded

    names = ["name", "domain", "industry", "country", "domains", "industries", "keywords", "countries"]
    schema = "name string, domain string, industry string, country string, domains array<string>, industries array<string>, keywords array<string>, countries array<string>"
    rows = [
        (("Acme", "acme.example", "Retail", "Sweden", ["https://www.ACME.example/x"], [], [], []), True),
        (("Acme", None, "Retail", "Sweden", ["acme.example"], [], [], []), False),
        (("Acme", "a.example", "Online Retail", "Sweden", [], ["retail"], [], []), True),
        (("Acme", "a.example", "Retail", "Sweden", [], [], ["CME RET"], []), True),
        (("Acme", "a.example", None, None, [], ["x"], ["y"], ["z"]), False),
        (("Acme", "a.example", "Retail", "New Sweden", [], [], [], ["sweden"]), True),
        (("Acme", "a.example", "Retail", "Sweden", None, None, None, None), False),
    ]
    found = spark.createDataFrame([r for r, _ in rows], schema).select(excluded(*map(F.col, names)).alias("out")).collect()
    assert [r["out"] for r in found] == [out for _, out in rows]


@pytest.mark.parametrize(
    "href, path",
    [
        ("/team/", "/team"), ("team/us?x=1#y", "/team/us"), ("https://www.Acme.example/About", "/About"), ("//acme.example/a/", "/a"), ("http://other.example/team", None), ("https://acme.example.evil.example/team", None),
        ("/", None), ("https://acme.example", None), ("/board.PDF", None), ("/" + "x" * 120, None), ("javascript:void(0)", None), ("tel:+123", None), (" /our-team ", "/our-team"), ("?q=1", None), (None, None),
    ],
)
def test_paths_on_the_same_host(spark, href, path):
    from pyspark.sql import functions as F

    from quarrymill.operators.site_paths import site_path

    df = spark.createDataFrame([(href, "www.acme.example")], "href string, host string")
    assert df.select(site_path(F.col("href"), F.col("host"))).first()[0] == path

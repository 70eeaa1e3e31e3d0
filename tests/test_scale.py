"""Plans that must stay small, and work that must be dealt to several tasks, whatever file it comes from."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrymill import plans, registry
from quarrymill.functions import intent, small_rules, text
from quarrymill.operators import html_nodes, json_tree, page_people, term_search
from quarrymill.sources import cases, model
from quarrymill.sources.staging import spread, staged
from quarrymill.streaming import timers

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def plan_of(df, capsys) -> str:
    df.explain("simple")
    return capsys.readouterr().out


def test_spread_deals_one_row_group_to_several_tasks(spark):
    one = spark.range(0, 10_000, 1, 1)
    assert spread(one, "id").rdd.getNumPartitions() == 1
    dealt = spread(one, "id", 1_000)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.distinct().count() == 10_000


def test_rows_of_cases_and_companies_are_dealt(spark, tmp_path):
    n = 50_000
    spark.range(0, n, 1, 1).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    for df in (cases.cases(spark, str(tmp_path), {"a": ["x", "y"]}), model.companies(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == 3 and df.count() == n


def test_once_works_out_its_value_once(spark):
    twice = spark.range(3).select(text.once(F.col("id") + 1, lambda v: v * v).alias("v"))
    assert [r["v"] for r in twice.collect()] == [1, 4, 9]


def test_text_of_a_reply_asks_each_part_once(spark, capsys):
    """A step of the mail's parts that repeats those before it makes the expression grow by a power."""
    df = spark.createDataFrame([("{}", "x")], "payload string, fallback string")
    plan = plan_of(df.select(small_rules.reply_text(small_rules.part_text(F.col("payload")), F.col("fallback")).alias("t")), capsys)
    assert plan.count("get_json_object") <= 40


@needs_data
@pytest.mark.parametrize("name", ["FLT11_relaxed_tiers", "FLT11_tiers_by_search"])
def test_no_filter_repeats_the_tests_of_a_tier(spark, capsys, name):
    lines = plan_of(registry.QUERIES[name](spark, DATA), capsys).splitlines()
    assert not any("Filter" in line and "RLIKE" in line.upper() for line in lines)


def test_a_search_asks_for_its_model_once(spark, capsys):
    df = spark.createDataFrame([("", "Technology", "Germany", ["ml"], 10)], "n string, i string, c string, k array<string>, s int")
    plan = plan_of(df.select(intent.query_variants(*map(F.col, "nicks")).alias("q")), capsys)
    assert plan.count("software as a service") <= 2


def test_spelling_sends_a_word_once(spark, tmp_path):
    """Rows that leave a task follow the distinct words, not the rows that hold them nor the pairs that meet."""
    names = spark.range(300).select(F.concat(F.lit("Name "), F.substring(F.md5(F.col("id").cast("string")), 1, 7)).alias("name"))
    typed = spark.range(3_000).select(F.col("id").alias("typed_id"), F.concat(F.lit("nam "), F.substring(F.md5((F.col("id") % 30).cast("string")), 1, 7)).alias("typed"))
    sent = []

    def counting(df, name):
        sent.append((name, df.count()))
        return staged(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(term_search, "staged", counting)
        rows = term_search.spelled(typed, names).collect()
    assert len(rows) == 3_000 and {r["distance"] for r in rows} == {1}
    assert [n for name, n in sent if name == "typed-words"] == [30, 30, 0, 0]
    assert sum(n for name, n in sent if name == "spelled") == 30


def test_a_page_is_parsed_once(spark, capsys):
    pages = spark.createDataFrame([(1, "<body><div><h3>Jane Doe</h3>\n<p>CEO</p></div></body>", "https://acme.example/team")], "page long, html string, url string")
    df = page_people.people(pages)
    assert plan_of(df, capsys).count("MapInArrow") == 0 and len(df.head()["people"]) == 1


def test_rows_of_pages_do_not_pass_through_the_driver(spark, capsys, monkeypatch):
    """A written table's rows are many times its file, so a size check that sees the file sends whole tables to all."""
    told = []

    def watched(df, name):
        told.append(plan_of(df, capsys))
        return staged(df, name)

    monkeypatch.setattr(page_people, "staged", watched)
    pages = staged(spark.createDataFrame([(1, "<body><div><h3>Jane Doe</h3>\n<p>CEO</p></div></body>", "https://acme.example/news/team")], "page long, html string, url string"), "pages")
    told.append(plan_of(page_people.people(pages), capsys))
    assert [p.count("Broadcast") for p in told] == [0] * 4


@needs_data
@pytest.mark.parametrize("name", ["HTM5_people_on_page", "HTM5_people_of_companies", "HTM8_press_people"])
def test_no_query_of_people_sends_pages_to_all(spark, capsys, name):
    assert plans
    assert "Broadcast" not in plan_of(registry.QUERIES[name](spark, DATA), capsys)


def test_rows_of_elements_leave_in_small_batches(spark):
    html_nodes.nodes(spark.createDataFrame([(1, "<p>x")], "page long, html string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(html_nodes._BATCH_BYTES)


def test_typed_objects_are_read_where_they_lie(spark, capsys):
    nodes = json_tree.json_nodes(spark.createDataFrame([(1, '{"a":{"@type":["X","Org"],"b.c":[1,null]}}'), (2, '{"@type":7,"n":"Org"}')], "id long, json string"))
    df = json_tree.typed_nodes(nodes, "^Org$")
    assert "Exchange" not in plan_of(df, capsys)
    assert [(r["id"], r["path"], r["fields"]) for r in df.collect()] == [(1, "$.a", {"@type": '["X","Org"]', "b.c": "[1,null]"})]


_MINUTE = 60_000
_START = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def _writes(seed: int) -> list[tuple]:
    """kind, key, number, minute of three hours; many rows share a minute, few keys many rows."""
    rng = random.Random(seed)
    return [(rng.choice("mmr"), f"k{min(rng.randrange(400), rng.randrange(400))}", n, rng.randrange(180)) for n in range(3_000)]


def _streamed(spark, place, rows, run):
    """What run gives of the rows, an hour a file, and how many rows its state holds in the end."""
    for hour in range(3):
        part = [(kind, key, n, datetime(2024, 1, 1) + timedelta(minutes=m)) for kind, key, n, m in rows if m // 60 == hour]
        spark.createDataFrame(part, "kind string, key string, n long, at timestamp").coalesce(1).write.parquet(f"{place}/in/part={hour}")
    stream = spark.readStream.schema("kind string, key string, n long, at timestamp").parquet(f"{place}/in")
    query = run(stream).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out"), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_entries_share_states(spark, tmp_path, monkeypatch):
    """A state a key, and a row an entry, cost more than the work on them; what is told is the same however keys are dealt."""
    monkeypatch.setattr(timers, "BUCKETS", 8, raising=False)
    rows = _writes(1)
    told, kept = _streamed(spark, tmp_path, rows, lambda df: timers.expiries(df.select("key", F.col("n").alias("entry"), "at"), 30 * _MINUTE))
    past, expected = max(m for *_, m in rows) - 10, set()
    for _, key, n, m in rows:
        later = [(o, x) for _, k, x, o in rows if k == key and (o, x) > (m, n)]
        if m + 30 <= past and not (later and min(later)[0] <= m + 30):
            expected.add((key, n, _START + (m + 30) * _MINUTE))
    found = [tuple(r) for r in told.select("key", "entry", F.unix_millis("expired_at")).collect()]
    assert len(found) == len(expected) > 100 and set(found) == expected
    assert kept <= 8 * 4


def test_follow_ups_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "BUCKETS", 8, raising=False)
    rows = _writes(2)
    run = lambda df: timers.follow_ups(*[df.where(f"kind = '{k}'").select(F.col("key").alias("person"), F.col("n").alias("mail_id"), "at") for k in "mr"], 30 * _MINUTE)
    told, kept = _streamed(spark, tmp_path, rows, run)
    past, expected = max(m for *_, m in rows) - 10, set()
    for kind, key, n, m in rows:
        if kind == "m" and m + 30 <= past:
            answer = min((o for k, x, _, o in rows if k == "r" and x == key and m < o <= m + 30), default=None)
            expected.add((key, n, "due" if answer is None else "cancelled", _START + (m + 30 if answer is None else answer) * _MINUTE))
    found = [tuple(r) for r in told.select("person", "mail_id", "state", F.unix_millis("at")).collect()]
    assert len(found) == len(expected) > 100 and set(found) == expected
    assert kept <= 8 * 4


def test_states_are_fewer_than_people(spark, tmp_path):
    """As many people as events has at 6 times sf0.1: what a state costs must not be paid for nearly each of them."""
    rows = spark.range(0, 9_000, 1, 1).select(F.col("id").alias("person"), F.col("id").alias("mail_id"), F.timestamp_seconds(F.lit(_START // 1000)).alias("at"), (F.col("id") % 2 == 0).alias("mail"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("person long, mail_id long, at timestamp, mail boolean").parquet(f"{tmp_path}/in")
    out = timers.follow_ups(stream.where("mail"), stream.where("not mail"), 30 * _MINUTE)
    query = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = query.recentProgress[0]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"]
    assert 0 < states <= 9_000 / 2


def test_metadata_is_read_page_by_page(spark, capsys):
    """No row of an element leaves its task; a page is one row whatever its key, and a null one too."""
    html = "<title> T </title><meta name=description><meta name=description content=D><p>" + "<b>x</b>" * 6_000 + "<p>y<a href=https://x.com/a>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (None, "<title>N</title>"), (4, "<a>no</a><p> </p><p>z</p>")], "page int, html string")
    df = page_people.metadata(pages)
    assert "Exchange" not in plan_of(df, capsys) and df.schema["page"].dataType.simpleString() == "int"
    told = {r["page"]: (r["title"], r["description"], r["twitter"]) for r in df.collect()}
    assert told == {1: ("T", "x" * 280, "https://x.com/a"), 2: (None,) * 3, 3: (None,) * 3, None: ("N", None, None), 4: (None,) * 3}

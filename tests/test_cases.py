"""Queries without SQL against brute force; branches that must occur; relational operators on awkward rows."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrymill import registry
from quarrymill.functions import people, titles
from quarrymill.operators import relational
from quarrymill.plans import by_search
from quarrymill.sources import cases, model
from quarrymill.streaming import follow_ups

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@needs_data
def test_breaker_over_the_events(spark):
    events = model.table(spark, DATA, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"), "value").orderBy("at").collect()
    failures, misses, until, expected = {}, {}, {}, []
    for tool, at, value in events:
        if tool in until and at.replace(microsecond=0) < until[tool].replace(microsecond=0):
            continue
        outcome = "failure" if value < 20 else "miss" if value < 60 else "ok"
        failures[tool] = failures.get(tool, 0) + 1 if outcome == "failure" else 0 if outcome == "ok" else failures.get(tool, 0)
        misses[tool] = misses.get(tool, 0) + 1 if outcome == "miss" else 0 if outcome == "ok" else misses.get(tool, 0)
        if failures[tool] >= follow_ups.FAILURES or misses[tool] >= follow_ups.MISSES:
            until[tool] = at + timedelta(minutes=follow_ups.OFF_MINUTES)
            failures[tool] = misses[tool] = 0
            expected.append((tool, at))
    found = [(r["tool"], r["off_from"]) for r in registry.QUERIES["STM4_breaker"](spark, DATA).collect()]
    assert sorted(found) == sorted(expected) and expected


@needs_data
def test_searches_differ_in_every_criterion(spark):
    rows = registry.QUERIES["FLT2_criteria_by_search"](spark, DATA).collect()
    for name in ("conflict", "in_country", "in_size", "has_technologies"):
        assert {r[name] for r in rows} == {True, False}, name
    reasons = {r["reasons"] for r in registry.QUERIES["FLT10_validation_by_search"](spark, DATA).collect()}
    assert {part for r in reasons for part in r.split(";")} >= {"", "industry", "country", "size"}
    assert len({r["fits"] for r in registry.QUERIES["FLT17_titles_by_search"](spark, DATA).collect()}) == 2


@needs_data
def test_tiers_keep_all_accepted(spark, monkeypatch):
    monkeypatch.setattr(by_search, "WANTED", 0)  # nothing is filled up, nothing accepted is lost
    accepted = registry.QUERIES["FLT10_validation_by_search"](spark, DATA).where("reasons = ''").count()
    found = registry.QUERIES["FLT11_tiers_by_search"](spark, DATA).collect()
    assert {r["tier"] for r in found} <= {0} and len(found) <= accepted


def test_first_per_key_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4), ("b", 5)], "key string, ord int")
    found = sorted(r["ord"] for r in relational.first_per_key(rows, F.col("key"), ["ord"]).collect())
    assert found == [1, 3, 4, 5]


def test_counters_of_rows_without_key(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "key string")
    known = spark.createDataFrame([("b",)], "key string")
    assert tuple(relational.dedup_counters(rows, known, "key").first()) == (2, 1, 1, 3)
    assert tuple(relational.dedup_counters(rows, known, "key", relink=False).first()) == (1, 1, 1, 4)
    assert tuple(relational.dedup_counters(rows.where("false"), known, "key").first()) == (0, 0, 0, 0)


def test_first_reply_comes_strictly_after(spark):
    sent = spark.createDataFrame([(1, "p", "2024-01-01 00:00:00"), (2, "p", "2024-01-01 00:00:05"), (3, "q", "2024-01-01 00:00:00"), (4, None, "2024-01-01 00:00:00")], "mail_id long, person string, sent_at string").withColumn("sent_at", F.to_timestamp("sent_at"))
    got = spark.createDataFrame([(11, "p", "2024-01-01 00:00:05"), (10, "p", "2024-01-01 00:00:05"), (12, "p", "2024-01-01 00:00:09"), (13, "q", "2024-01-01 00:00:00"), (14, None, "2024-01-02 00:00:00")], "reply_id long, person string, reply_at string").withColumn("reply_at", F.to_timestamp("reply_at"))
    for span in ("day", "minute", "second"):
        assert sorted(map(tuple, relational.replies_to_mails(got, sent, span).collect())) == [(1, 10), (2, 12)]


def test_replies_are_carried_back_over_spans(spark):
    rng = random.Random(9)
    sent = [(i, "hot" if i % 3 else f"p{i % 7}", rng.randrange(0, 90 * 86_400)) for i in range(300)]
    got = [(1000 + i, "hot" if i % 4 else f"p{i % 7}", rng.randrange(0, 90 * 86_400)) for i in range(60)]
    expected = {}
    for mail, person, at in sent:
        after = [(t, r) for r, who, t in got if who == person and t > at]
        if after:
            expected[mail] = min(after)[1]
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} long, person string, s long").select(names[0], "person", F.timestamp_seconds("s").alias(names[1]))
    for span in ("hour", "day", "month"):
        found = relational.replies_to_mails(frame(got, ("reply_id", "reply_at")), frame(sent, ("mail_id", "sent_at")), span)
        assert {r["mail_id"]: r["reply_id"] for r in found.collect()} == expected


def test_pages_far_down_are_those_of_the_whole_sort(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i * 7919 % 101) for i in range(1000)], "id long, v long")
    order = [F.desc("v"), "id"]
    near = [tuple(r) for r in relational.page(rows, order, 9, 20).collect()]
    monkeypatch.setattr(relational, "NEAR", 10)
    far = relational.page(rows, order, 9, 20, keys=[-F.col("v"), F.col("id")]).collect()
    assert sorted(map(tuple, far)) == sorted(near) and len(near) == 20


def test_people_of_a_hot_first_name_do_not_pair(spark):
    left = spark.createDataFrame([(i, "c", f"Jane Doe{i}") for i in range(60)] + [(90, "c", "Jane")], "id long, company_id string, full_name string")
    right = spark.createDataFrame([(100 + i, "c", f"Jane M. Doe{i}") for i in range(60)] + [(300, "d", "Jane Doe1"), (301, "c", None), (302, "c", "")], "id long, company_id string, full_name string")
    found = {(r["left_id"], r["right_id"]) for r in people.match_people(left, right, "company_id").collect()}
    assert found == {(i, 100 + i) for i in range(60)} | {(90, 100 + i) for i in range(60)}


def test_titles_by_column_agree_with_titles_by_literal(spark):
    held = ["CTO", "Chief Executive Officer", "VP of Software Engineering", "Office Manager", "General Manager", "Software Engineer", "Board Member", "Team Member", "Co-Founder", None]
    rows = spark.createDataFrame([(t,) for t in held], "title string")
    for wanted in by_search.TITLES:
        row = rows.select(titles.title_matches(F.col("title"), wanted).alias("a"), titles.title_matches_any(F.col("title"), cases.literal(wanted)).alias("b")).collect()
        assert [r["a"] for r in row] == [r["b"] for r in row], wanted


def test_case_literals():
    assert cases.sql_literal("it's\na") == "'it''s' || chr(10) || 'a'" and cases.sql_literal([]) == "[]::VARCHAR[]" and cases.sql_literal(None) == "NULL" and cases.sql_literal(True) == "true"

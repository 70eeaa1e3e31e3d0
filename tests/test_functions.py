"""Single values: truth tables of the functions, CSV both ways, streams."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import countries, rules, text, titles
from quarrymill.operators import relational
from quarrymill.sources import csv_leads
from quarrymill.streaming import follow_ups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "wanted", "expected"),
    [
        ("Chief Executive Officer", ["CEO"], True),
        ("President & CEO", ["CEO"], True),
        ("Chief Technology Officer", ["CTO"], True),
        ("VP Engineering", ["CTO"], True),
        ("Head of Technology", ["CTO"], True),
        ("Co-Founder", ["Founder"], True),
        ("Co-Founder & CTO", ["CTO", "Founder"], True),
        ("Managing Director", ["Director"], True),
        ("Marketing Director", ["Director"], True),
        ("IT Director", ["Director"], True),
        ("General Manager", ["Manager"], True),
        ("Business Owner", ["Owner"], True),
        ("Workshop Manager", ["Manager"], False),
        ("Office Manager", ["Manager"], False),
        ("Team Member", ["CEO", "Founder"], False),
        ("Software Engineer", ["CEO"], False),
        ("Marketing Director", ["CEO"], False),
        ("Board Member", ["CEO"], False),
        ("Executive Director", ["CEO"], False),
        ("Former CEO at OtherCo", ["CEO"], False),
        ("Board Member", ["CEO", "Director"], False),
        ("Strategic Advisor", ["CEO", "Founder"], False),
        ("Advisory Board Member", ["Founder"], False),
        (None, ["CEO"], False),
    ],
)
def test_titles(spark, title, wanted, expected):
    assert one(spark, titles.title_matches(F.lit(title).cast("string"), wanted)) is expected


@pytest.mark.parametrize(("country", "target", "domain", "expected"), [(None, "Pakistan", "arbisoft.com.pk", True), ("PK", "Pakistan", None, True), ("UAE", "United Arab Emirates", None, True), ("Norway", "Sweden", "x.no", False), ("Norway", "", None, True)])
def test_countries(spark, country, target, domain, expected):
    assert one(spark, countries.matches(F.lit(country).cast("string"), target, F.lit(domain).cast("string"), F.lit(None).cast("string"))) is expected


@pytest.mark.parametrize(("said", "expected"), [("51-200 employees · Software", 126), ("1,200 employees", 1200), ("about 80 staff", 80), ("no count", None), ("", None)])
def test_employee_count(spark, said, expected):
    assert one(spark, text.employee_count(F.lit(said))) == expected


@pytest.mark.parametrize(("url", "expected"), [("https://www.butterbee.example/team", "butterbee.example"), ("https://www.linkedin.com/company/foo", None), ("foo.example", "foo.example")])
def test_domain_of_url(spark, url, expected):
    assert one(spark, text.domain_of_url(F.lit(url))) == expected


def test_email_guesses(spark):
    assert one(spark, text.email_guesses(F.lit("John Smith"), F.lit("abc.example"))) == ["john@abc.example", "john.smith@abc.example", "j.smith@abc.example", "johnsmith@abc.example"]
    assert one(spark, text.email_guesses(F.lit("Cher"), F.lit("abc.example"))) == ["cher@abc.example"]


@pytest.mark.parametrize(("said", "expected"), [("Thanks! On Mon, Jan wrote: previous message", "Thanks!"), ("Yes\n> quoted\nfine", "Yes\nfine"), ("Ok\n----- Original Message -----\nold", "Ok"), ("plain", "plain")])
def test_strip_quoted(spark, said, expected):
    assert one(spark, text.strip_quoted(F.lit(said))) == expected


def test_scores_at_their_limits(spark):
    ones = dict.fromkeys(("industry", "type", "size", "location", "role", "technology"), F.lit(1.0))
    zeros = dict.fromkeys(ones, F.lit(0.0))
    assert one(spark, rules.lead_score(ones, intent=F.lit(70))) == 10
    assert one(spark, rules.lead_score(zeros)) == 1
    assert one(spark, rules.lead_score(zeros, intent=F.lit(45))) == 1.5
    assert rules.six_weights({"industry": 25, "size": 20, "location": 20, "role": 20, "technology": 15})["industry"] == 13
    assert [one(spark, rules.quality_category(F.lit(n))) for n in (90, 89, 75, 74, 50, 49)] == ["excellent", "good", "good", "average", "average", "reject"]


def test_intent(spark):
    assert one(spark, rules.intent_score(F.lit("We raised a seed round and are expanding"))) == 55
    rows = rules.with_intent(spark.createDataFrame([("We are \n looking\nfor a vendor; join our team",), (None,)], "text string"), "text").select("intent").collect()
    assert [tuple(r[0]) for r in rows] == [(55, ["buying_language", "hiring"], ["We are looking for a vendor; join our team", "oking for a vendor; join our team"]), (0, [], [])]


def test_csv_both_ways(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text('Company Name,Website,Full Name,Email\n"Acme, ""Inc""",https://www.Acme.example/x,Jane Doe,JANE@acme.example\nAcme,acme.example,,\n,x.example,Nobody,\n')
    rows, errors = csv_leads.leads(csv_leads.read_raw(spark, str(path)))
    found = rows.orderBy("contactName").collect()
    assert [(r["company"], r["domain"], r["contactName"], r["title"], r["email"]) for r in found] == [('Acme, "Inc"', "acme.example", "Jane Doe", "Team Member", "jane@acme.example"), ("Acme", "acme.example", "Unknown Contact", "Team Member", None)]
    assert errors.count() == 1
    companies, contacts = csv_leads.entities(rows, "contactName")
    assert [r["company"] for r in companies.collect()] == ['Acme, "Inc"'] and contacts.count() == 2
    csv_leads.write(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert back.columns == csv_leads.EXPORT and {r["company"] for r in back.collect()} == {'Acme, "Inc"', "Acme"}
    assert csv_leads.csv_lines(rows.select("company")).collect()[0]["line"] == '"Acme, ""Inc"""'


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([(1, "a", "then"), (2, "b", "then")], "id long, name string, first_seen string")
    new = spark.createDataFrame([(2, "c", "now"), (3, "d", "now")], "id long, name string, first_seen string")
    assert sorted(map(tuple, relational.upsert(old, new, ["id"], ["first_seen"]).collect())) == [(1, "a", "then"), (2, "c", "then"), (3, "d", "now")]


def test_dedup_counters(spark):
    rows = spark.createDataFrame([("acme.example", 1)], "key string, ord int")
    known = spark.createDataFrame([("acme.example",)], "key string")
    assert tuple(relational.dedup_counters(rows, known, "key").first()) == (1, 0, 1, 0)
    assert tuple(relational.dedup_counters(rows, known, "key", relink=False).first()) == (0, 0, 1, 1)


def test_stream_dedup_and_breaker(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{s:02d}", o) for s, (k, o) in enumerate([("a", "failure"), ("a", "failure"), ("b", "ok"), ("a", "failure"), ("b", "miss"), ("a", "failure")])]
    data = spark.createDataFrame(rows, "tool string, at string, outcome string").withColumn("at", F.to_timestamp("at"))
    data.coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "calls"))
    for name, out, mode in (("kept", follow_ups.dedup(stream, "tool", "at", "1 minute").select("tool"), "append"), ("offs", follow_ups.breaker(stream), "append")):
        run = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert sorted(r["tool"] for r in spark.table("kept").collect()) == ["a", "b"]
    assert [(r["tool"], str(r["off_from"])) for r in spark.table("offs").collect()] == [("a", "2024-01-01 00:00:03")]


def test_cancel(spark):
    plans = spark.createDataFrame([(1, 10, "scheduled", None), (2, 11, "sent", None), (3, 12, "scheduled", None)], "id long, mail_id long, status string, cancel_reason string")
    found = spark.createDataFrame([(10,), (11,)], "mail_id long")
    assert {r["id"]: (r["status"], r["cancel_reason"]) for r in follow_ups.cancel(plans, found).collect()} == {1: ("cancelled", "replied"), 2: ("sent", None), 3: ("scheduled", None)}

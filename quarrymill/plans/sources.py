"""Queries over outside sources as input tables: pages, a graph of classes, listings; what a search asks them; a breaker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import intent, text
from ..registry import query
from ..sources import model
from ..sources.cases import case_query
from ..streaming import follow_ups

C = F.col

_SEARCHES = [  # name, industry, country, keywords, largest size, models, queries
    ("", "Technology", "Germany", ["robots", "arms", "ml"], 500, "ai", "AI software company Germany|software technology company Germany|robots arms company Germany"),
    ("Acme CTO", "Healthcare", "Sweden", [], 100, "general", "Acme CTO Sweden|Acme CTO Healthcare Sweden|technology company Sweden|healthcare technology company Sweden|healthcare startup Sweden|digital health company Sweden|health IT company Sweden|health information technology Sweden|medical technology company Sweden|healthcare IT services Sweden|healthcare software SMB Sweden|small healthtech Sweden|healthtech software company Sweden|small healthcare company Sweden"),
    ("", "E-commerce", "France", ["b2b marketplace"], None, "b2b,marketplace,ecommerce", "e-commerce online store France|online retailer France|ecommerce company France|B2B technology company France|e-commerce company France|b2b marketplace company France"),
    ("Big Data", "Mining", "", [], None, "general", "Big Data|technology company|Mining company"),
    ("", "", None, [], None, "general", "technology company"),
]
case_query(
    "STR29_query_variants",
    {c: [s[i] for s in _SEARCHES] for i, c in enumerate(("name", "industry", "country", "keywords", "size_max"))},
    lambda df: {"models": F.array_join(intent.business_models(F.concat_ws(" ", "name", "industry", "country", "keywords")), ","), "queries": F.array_join(intent.query_variants(C("name"), C("industry"), C("country"), C("keywords"), C("size_max")), "|")},
    {"models": [s[5] for s in _SEARCHES], "queries": [s[6] for s in _SEARCHES]},
)

_KNOWN = ["Healthcare", "Hospitality", "Health", "Digital Health", "Finance", "Retail"]
_TYPED = [("health", "Health", "Healthcare|Health|Digital Health", None), ("Helth", None, "", "Health"), ("ho", None, "Hospitality", None), ("finence", None, "", "Finance"), ("al", None, "Healthcare|Hospitality|Health|Digital Health", None), ("xx", None, "", None), ("", None, "Healthcare|Hospitality|Health|Digital Health|Finance|Retail", None), ("reteil", None, "", "Retail"), ("ratail", None, "", None)]
case_query(
    "STR27_ranked_suggestions",
    {"typed": [t[0] for t in _TYPED], "known": [_KNOWN] * len(_TYPED)},
    lambda df: {"exact": intent.exact_suggestion(C("typed"), C("known")), "ranked": F.array_join(intent.ranked_suggestions(C("typed"), C("known")), "|"), "spelled": intent.spell_suggestion(C("typed"), C("known"))},
    {"exact": [t[1] for t in _TYPED], "ranked": [t[2] for t in _TYPED], "spelled": [t[3] for t in _TYPED]},
)

_MAILS = [("Jane <JANE@acme.example>", "jane@acme.example", "Re: hello", "hello", True), ("jane@acme.example", "jane@acme.example", "thoughts on A quick question about robots", "A quick question about arms", True), ("jane@acme.example", "jane@acme.example", "lunch", "A quick question", False), ("bob@acme.example", "jane@acme.example", "Re: hello", "hello", False), ("jane@acme.example", "jane@acme.example", " FWD: x", None, True), ("jane@acme.example", "jane@acme.example", "x", "", False)]
case_query("FLT29_replies", {c: [m[i] for m in _MAILS] for i, c in enumerate(("sender", "recipient", "subject", "original"))}, lambda df: {"reply": intent.is_reply(C("sender"), C("recipient"), C("subject"), C("original"))}, {"reply": [m[4] for m in _MAILS]})

_PROFILES = [("Jane van Doe", "j@x.example", "Jane van Doe", "JV"), (" jane ", "j@x.example", "jane", "J"), (None, "bob@x.example", "bob", "B"), ("", "@x.example", "User", "U")]
case_query("STR28_profiles", {"name": [p[0] for p in _PROFILES], "email": [p[1] for p in _PROFILES]}, lambda df: {"shown": intent.display_name(C("name"), C("email")), "initials": intent.initials(C("name"), C("email"))}, {"shown": [p[2] for p in _PROFILES], "initials": [p[3] for p in _PROFILES]})
case_query("STR28_masked_keys", {"key": ["sk-1234567890abcd", "12345678", "123456789"]}, lambda df: {"masked": intent.masked_key(C("key"))}, {"masked": ["sk-••••abcd", "••••••••", "123••••6789"]})

_GUESSES = [("Jane Doe", "jane@a.example jane.doe@a.example j.doe@a.example janedoe@a.example"), ("Jane van Doe", "jane@a.example jane.vandoe@a.example j.vandoe@a.example janevandoe@a.example"), ("Jane", "jane@a.example")]
case_query("STR11_guesses", {"name": [n for n, _ in _GUESSES]}, lambda df: {"guesses": F.array_join(text.email_guesses(C("name"), F.lit("a.example")), " ")}, {"guesses": [g for _, g in _GUESSES]})


@query("SRC7_page_source", "SELECT page_id, regexp_extract(lower(url), '^(?:https?://)?([^/:?#\\s]+)', 1) AS host, length(html) < 200 AS tiny, contains(html, '<article') AS has_article FROM pages WHERE html IS NOT NULL AND regexp_matches(url, '^https?://', 'i')")
def page_source(spark, sf_dir):
    """Pages as fetched, a table: each with its host and whether it is too small to be read without a browser."""
    pages = model.table(spark, sf_dir, "pages").where(C("html").isNotNull() & C("url").rlike("(?i)^https?://"))
    return pages.select("page_id", F.regexp_extract(F.lower("url"), r"^(?:https?://)?([^/:?#\s]+)", 1).alias("host"), (F.length("html") < 200).alias("tiny"), F.contains("html", F.lit("<article")).alias("has_article"))


#: Classes and what they are a kind of.
_KINDS = [("BUILDING", "CONSTRUCTION"), ("CONSTRUCTION", "INDUSTRY"), ("MACHINERY", "INDUSTRY"), ("INDUSTRY", "BUSINESS"), ("AUTOMOBILE", "TRANSPORT"), ("TRANSPORT", "BUSINESS"), ("HOUSEHOLD", "PRIVATE")]
_KINDS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _KINDS)


@query(
    "SRC8_directory_graph",
    f"""WITH RECURSIVE kinds(a, b) AS (VALUES {_KINDS_SQL}), below AS (SELECT 'INDUSTRY' AS kind UNION SELECT a FROM kinds JOIN below ON b = kind)
 SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 10 <> 0 THEN 'https://' || lower(replace(c_name, '#', '-')) || '.example' END AS website
 FROM customer JOIN below ON c_mktsegment = kind JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND contains(lower(c_name), '1')""",
)
def directory_graph(spark, sf_dir):
    """Instances of a class or of any class below it: a recursive query over the classes alone, then joins; a missing site is null."""
    kinds = spark.createDataFrame(_KINDS, "a string, b string")
    below = spark.sql("WITH RECURSIVE below(kind) AS (SELECT 'INDUSTRY' UNION ALL SELECT a FROM {kinds} JOIN below ON b = kind) SELECT DISTINCT kind FROM below", kinds=kinds)
    found = model.table(spark, sf_dir, "customer").where(F.lower("c_name").contains("1")).join(below, C("c_mktsegment") == C("kind"), "left_semi")
    here = model.table(spark, sf_dir, "nation").where("n_name = 'NATION_3'")
    site = F.when(C("c_custkey") % 10 != 0, F.concat(F.lit("https://"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example")))
    return found.join(here, C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").alias("id"), C("c_name").alias("title"), site.alias("website"))


_HOST = "'f' || (s_suppkey % 40) || '.example'"


@query(
    "SRC11_listings",
    f"""SELECT domain, title, source FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, id) AS nth FROM (
 SELECT s_suppkey AS id, 1 AS rank, 'places' AS source, s_name AS title, {_HOST} AS domain FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey, 2, 'registry', upper(s_name), {_HOST} FROM supplier WHERE s_suppkey % 3 = 1
 UNION ALL SELECT s_suppkey, 3, 'web', trim(s_name || ' - Home'), {_HOST} FROM supplier WHERE s_suppkey % 3 = 2)) WHERE nth = 1""",
)
def listings(spark, sf_dir):
    """Sources of unlike layout in one; of a domain the entry of the best source stays, by an aggregate that combines early."""
    s = model.table(spark, sf_dir, "supplier")
    key, host = C("s_suppkey"), F.concat(F.lit("f"), C("s_suppkey") % 40, F.lit(".example"))
    places = s.where(key % 3 == 0).select(key.alias("id"), F.lit(1).alias("rank"), F.lit("places").alias("source"), C("s_name").alias("title"), F.concat(F.lit("https://www."), host, F.lit("/")).alias("url"))
    registry = s.where(key % 3 == 1).select(key.alias("id"), F.lit(2).alias("rank"), F.lit("registry").alias("source"), F.upper("s_name").alias("title"), F.upper(host).alias("url"))
    web = s.where(key % 3 == 2).select(key.alias("id"), F.lit(3).alias("rank"), F.lit("web").alias("source"), F.concat("s_name", F.lit(" - Home")).alias("title"), F.concat(F.lit("http://"), host, F.lit("/about")).alias("url"))
    rows = places.union(registry).union(web).withColumn("domain", text.normalize_domain(C("url")))
    return rows.groupBy("domain").agg(F.min(F.struct("rank", "id", "title", "source")).alias("m")).select("domain", "m.title", "m.source")


@query("STM4_breaker")
def breaker(spark, sf_dir):
    """The breaker as a stream over the events that are there: a tool a kind of event, small values fail and others miss."""
    schema = model.table(spark, sf_dir, "events").schema
    calls = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    outcome = F.when(C("value") < 20, "failure").when(C("value") < 60, "miss").otherwise("ok")
    calls = calls.select(C("event_type").alias("tool"), C("ts").cast("timestamp").alias("at"), outcome.alias("outcome"))
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    place = f"{root.rstrip('/')}/breaker-{uuid.uuid4().hex}"
    run = follow_ups.breaker(calls).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    run.awaitTermination()
    return spark.read.schema("tool string, off_from timestamp, off_until timestamp").parquet(f"{place}/rows")

"""Queries over contacts, countries, robots files, searches, weights, mails, sources and runs, on stated cases and tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contacts, rules
from ..functions import small_rules as S
from ..functions.text import domain_of_url
from ..registry import query
from ..sources import csv_leads, model
from ..sources.cases import case_query, cases
from ..sources.model import with_views

C = F.col

_MAILS = [  # address, name, profile, shared, own, tier
    ("jane.doe@acme.example", "Jane Doe", None, False, True, "high"),
    ("jdoe@acme.example", "Jane Doe", None, False, True, "high"),
    ("jd@acme.example", "Jane Doe", "x", False, True, "high"),
    ("j.d.smith@acme.example", "Jane Doe", "x", False, False, "low"),
    ("Sales-2@acme.example", "Jane Doe", "x", True, False, "low"),
    ("info@acme.example", "Jane Doe", None, True, False, "low"),
    ("user@example.com", "Jane Doe", "x", False, False, "medium"),
    ("jane@test.com", "Jane Doe", None, False, True, "low"),
    (None, "Jane Doe", "x", True, False, "medium"),
    ("", "Jane Doe", " ", True, False, "low"),
    ("no address", "Jane Doe", "x", False, False, "medium"),
    ("drjanethedoe@acme.example", "Dr. Jane Doe", None, False, True, "high"),
    ("jane@acme.example", "Jane", None, False, True, "high"),
]
case_query(
    "CLS6_quality_tier",
    {c: [m[i] for m in _MAILS] for i, c in enumerate(("email", "name", "profile"))},
    lambda df: {"tier": contacts.quality_tier(C("email"), C("name"), C("profile"))},
    {"tier": [m[5] for m in _MAILS]},
)
case_query(
    "FLT20_email_predicates",
    {c: [m[i] for m in _MAILS] for i, c in enumerate(("email", "name"))},
    lambda df: {"shared": contacts.is_shared(C("email")), "own": contacts.is_own(C("email"), C("name"))},
    {"shared": [m[3] for m in _MAILS], "own": [m[4] for m in _MAILS]},
)
_PICKS = [  # linked address, candidates, the person's, the firm's
    ("Jane.Doe@acme.example", ["info@acme.example"], "jane.doe@acme.example", "jane.doe@acme.example"),
    ("info@acme.example", ["sales@acme.example", "JDoe@acme.example", "jane@acme.example"], "jdoe@acme.example", "info@acme.example"),
    ("someone@example.com", ["bob@acme.example"], None, None),
    (None, ["jane@acme.example"], "jane@acme.example", None),
]
case_query(
    "STR12_email_pickers",
    {"mailto": [p[0] for p in _PICKS], "candidates": [p[1] for p in _PICKS]},
    lambda df: {"best": contacts.best_email(C("mailto"), C("candidates"), F.lit("Jane Doe")), "public": contacts.public_email(C("mailto"))},
    {"best": [p[2] for p in _PICKS], "public": [p[3] for p in _PICKS]},
)
_REACH = [  # address, found, profile, from the site, status, kind, score
    ("jane@acme.example", True, "x", True, "verified", None, 77),
    ("jane@acme.example", True, "x", False, "likely_valid", None, 58),
    ("jane@acme.example", True, None, False, "risky", None, 8),
    ("user@example.com", True, "x", False, "risky", None, 38),
    ("user@example.com", True, "x", True, "risky", "public_email", 34),
    ("user@example.com", False, "x", False, "risky", None, 18),
    (None, False, "x", False, None, None, 28),
    (None, False, None, False, None, "contact_page_only", 15),
    ("jane@acme.example", False, None, False, "invalid", None, 0),
]
case_query(
    "SCO9_contact_score",
    {c: [r[i] for r in _REACH] for i, c in enumerate(("email", "found", "profile", "site", "shown", "detail"))},
    lambda df: {"score": contacts.contact_score(C("email"), C("found"), C("profile"), C("site"), C("shown"), C("detail"))},
    {"score": [r[6] for r in _REACH]},
)

_COUNTRIES = [("USA", "acme.co.uk", "us", "Q30", "united kingdom"), (" Great  Britain ", "acme.com", None, None, None), ("UK", "www.acme.de", "gb", "Q145", "germany"), ("Czech Republic", "acme", "cz", None, None), ("Egypt", "acme.eg", "eg", "Q79", "egypt"), (None, None, None, None, None), ("u.s.a.", "acme.io", "us", "Q30", None)]
case_query(
    "STR22_country_codes",
    {"country": [c[0] for c in _COUNTRIES], "domain": [c[1] for c in _COUNTRIES]},
    lambda df: {"iso": S.iso_code(C("country")), "entity": S.entity(C("country")), "hint": S.country_of_domain(C("domain"))},
    {"iso": [c[2] for c in _COUNTRIES], "entity": [c[3] for c in _COUNTRIES], "hint": [c[4] for c in _COUNTRIES]},
)

_ROBOTS = [
    ("User-agent: *\nDisallow: /private\n# a note\nDisallow:\n\nUser-agent: other\nDisallow: /", "/private/a", "/private", False),
    ("User-agent: other\nDisallow: /\nUser-Agent: OurBot/1.0\nDISALLOW: /a:b", "/a", "/a:b", True),
    ("User-agent: *\nDisallow: /", "/any", "/", False),
    ("Disallow: /early\nUser-agent: *\nAllow: /", "/early", "", True),
    (None, "/any", "", True),
]
case_query(
    "FLT24_robots",
    {"content": [r[0] for r in _ROBOTS], "path": [r[1] for r in _ROBOTS]},
    lambda df: {"rules": F.array_join(S.robots_rules(C("content"), "ourbot"), ","), "allowed": S.may_fetch(C("path"), S.robots_rules(C("content"), "ourbot"))},
    {"rules": [r[2] for r in _ROBOTS], "allowed": [r[3] for r in _ROBOTS]},
)

_FINE = {"name": "Robots", "industry": "Technology", "country": "Germany", "size_min": "10", "size_max": "200", "keywords": "robots, arms", "technologies": "React", "job_titles": "CEO", "exclude_domains": "", "exclude_industries": "", "exclude_keywords": "", "exclude_countries": ""}
_many = lambda n: ", ".join(f"w{i}" for i in range(n))
_SEARCHES = [
    ({}, ""),
    ({"name": " "}, "name: Search name is required."),
    ({"name": "x" * 101}, "name: Name must be 100 characters or less."),
    ({"industry": "", "country": None}, "industry: Industry is required.|country: Country is required."),
    ({"size_min": "", "size_max": ""}, "companySize: Company size is required."),
    ({"size_min": "ten"}, "companySize: Company size must be a valid number."),
    ({"size_min": "0"}, "companySize: Minimum company size must be at least 1."),
    ({"size_min": "", "size_max": "-3"}, "companySize: Maximum company size must be at least 1."),
    ({"size_min": "300"}, "companySize: Minimum size cannot exceed maximum size."),
    ({"job_titles": " , "}, "jobTitles: At least one job title is required."),
    ({"job_titles": _many(11), "keywords": _many(21), "technologies": _many(21)}, "jobTitles: Maximum 10 job titles allowed.|keywords: Maximum 20 keywords allowed.|technologies: Maximum 20 technologies allowed."),
    ({"exclude_domains": "acme.example, not a domain"}, 'excludeDomains: "not a domain" is not a valid domain.'),
    ({"exclude_domains": ", ".join(f"d{i}.example" for i in range(51))}, "excludeDomains: Maximum 50 excluded domains allowed."),
    ({"exclude_domains": ", ".join("https://www.acme.example/x" for _ in range(60))}, ""),
    ({"exclude_industries": "Retail, Technology", "exclude_countries": "Germany"}, "excludeIndustries: Cannot exclude the same industry you are targeting.|excludeCountries: Cannot exclude the same country you are targeting."),
    ({"exclude_industries": _many(16), "exclude_keywords": _many(21), "exclude_countries": _many(16)}, "excludeIndustries: Maximum 15 excluded industries allowed.|excludeKeywords: Maximum 20 excluded keywords allowed.|excludeCountries: Maximum 15 excluded countries allowed."),
]
case_query(
    "FLT26_search_validation",
    {c: [(_FINE | s)[c] for s, _ in _SEARCHES] for c in _FINE},
    lambda df: {"problems": F.array_join(S.search_problems({c: C(c) for c in _FINE}), "|")},
    {"problems": [p for _, p in _SEARCHES]},
)

_STORED = [((25, 20, 20, 20, 15), "13,12,20,20,20,15", None), ((24, 20, 20, 20, 15), "12,12,20,20,20,15", "Weights must sum to 100 (currently 99)."), ((1, 99, 0, 0, 0), "1,0,99,0,0,0", None), ((0, 101, 0, 0, 0), "0,0,101,0,0,0", "companySize must be an integer between 0 and 100."), ((-3, 100, 3, 0, 0), "-1,-2,100,3,0,0", "industryMatch must be an integer between 0 and 100.")]


def _weights(df):
    six = S.six_weights(*[C(c) for c in ("industry", "size", "location", "role", "technology")])
    return {"six": F.concat_ws(",", *[w.cast("string") for w in six]), "problem": S.weights_problem(six)}


case_query("SCO11_weights", {c: [s[0][i] for s in _STORED] for i, c in enumerate(("industry", "size", "location", "role", "technology"))}, _weights, {"six": [s[1] for s in _STORED], "problem": [s[2] for s in _STORED]})


def _part(text: str) -> dict:
    return {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")}}


_HTML = {"mimeType": "text/html", "body": {"data": "PGI-"}}
_REPLIES = [  # payload, fallback, text
    (json.dumps(_part("Thanks &amp; yes!\n\nOn Mon, 3 May 2021 at 10:00, Bob wrote:\n> hello")), None, "Thanks & yes!"),
    (json.dumps({"mimeType": "multipart/alternative", "parts": [_HTML, _part("Grüße? Ja.\n> old\nEnde")]}), None, "Grüße? Ja.\nEnde"),
    (json.dumps({"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/alternative", "parts": [_HTML, _part("deep\nFrom: Bob\nSent: today\nold")]}]}), None, "deep"),
    (json.dumps({"mimeType": "multipart/mixed", "parts": [_HTML]}), "only a snippet", "only a snippet"),
    (None, " ", "Reply received"),
    (json.dumps(_part("> all\n> quoted")), None, "> all\n> quoted"),
    (json.dumps(_part("x" * 600)), None, "x" * 499 + "…"),
    (json.dumps(_part("a\nFrom: Bob\nSent: b\nOn Mon, we wrote: c")), None, "a\nFrom: Bob\nSent: b"),
]
case_query("STR25_reply_text", {"payload": [r[0] for r in _REPLIES], "fallback": [r[1] for r in _REPLIES]}, lambda df: {"text": S.reply_text(S.part_text(C("payload")), C("fallback"))}, {"text": [r[2] for r in _REPLIES]})

_TIMES = [("2024-05-10 11:59:30", "just now"), ("2024-05-10 11:58:59", "1m ago"), ("2024-05-10 10:00:01", "1h ago"), ("2024-05-09 11:00:00", "1d ago"), ("2024-05-04 12:00:00", "6d ago"), ("2024-05-03 12:00:00", "May 3"), ("2023-12-31 00:00:00", "Dec 31")]
case_query("DATE_relative_label", {"at": [t for t, _ in _TIMES]}, lambda df: {"label": S.relative_label(C("at").cast("timestamp"), F.lit("2024-05-10 12:00:00").cast("timestamp"))}, {"label": [x for _, x in _TIMES]})

case_query(
    "STR30_literals",
    {"value": ["O'Neil", 'a "b" \\ c', "''", None]},
    lambda df: {"sql": S.sql_string(C("value")), "quoted": S.quoted_string(C("value"))},
    {"sql": ["O''Neil", 'a "b" \\ c', "''''", None], "quoted": ["O'Neil", 'a \\"b\\" \\\\ c', "''", None]},
)

# fixed values: the companies of the source that needs no network
MOCK_COMPANIES = [
    ("ABC Health", "abchealth.com", "Healthcare", 120, "United States", "Boston", "MA", "https://linkedin.com/company/abc-health", ["Salesforce", "AWS"]),
    ("MedTech Pro", "medtechpro.com", "Healthcare", 300, "United States", "San Francisco", "CA", "https://linkedin.com/company/medtech-pro", ["React", "AWS", "PostgreSQL"]),
    ("CareSync", "caresync.io", "Healthcare", 80, "United States", "Austin", "TX", "https://linkedin.com/company/caresync", ["Node.js", "HubSpot"]),
    ("HealthBridge", "healthbridge.com", "Healthcare", 450, "United States", "Chicago", "IL", None, ["Salesforce", "Azure"]),
    ("NovaCare Systems", "novacare.com", "Healthcare", 210, "United States", "Seattle", "WA", None, ["React", "Node.js", "Docker"]),
    ("Competitor Labs", "competitor.com", "Healthcare", 150, "United States", "Denver", "CO", None, ["WordPress"]),
    ("FinEdge", "finedge.com", "Financial Services", 90, "United Kingdom", "London", None, None, ["Salesforce", "Python"]),
    ("TechFlow", "techflow.io", "Technology", 65, "Canada", "Toronto", "ON", None, ["React", "Kubernetes", "PostgreSQL"]),
    ("ButterBee", "butterbee.co", "Technology", 10, "Pakistan", "Islamabad", None, None, ["Next.js", "Node.js"]),
]
_MOCK = "name string, domain string, industry string, employee_count int, country string, city string, state string, linkedin_url string, technologies array<string>"
_MOCK_SQL = ", ".join(f"({i}, '{m[0]}', '{m[1]}', '{m[2]}', {m[3]}, '{m[4]}', '{m[5]}')" for i, m in enumerate(MOCK_COMPANIES))


@query(
    "SRC12_mock_companies",
    f"""SELECT 'mock-' || i AS id, name, 'https://' || domain AS website_url, name || ' is a ' || lower(industry) || ' company.' AS description, employee_count, 88 AS confidence
 FROM (VALUES {_MOCK_SQL}) m(i, name, domain, industry, employee_count, country, city)""",
)
def mock_companies(spark, sf_dir):
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(MOCK_COMPANIES)], "i int, " + _MOCK)
    return rows.select(F.concat(F.lit("mock-"), C("i")).alias("id"), "name", F.concat(F.lit("https://"), C("domain")).alias("website_url"), F.concat(C("name"), F.lit(" is a "), F.lower("industry"), F.lit(" company.")).alias("description"), "employee_count", F.lit(88).alias("confidence"))


@query(
    "SRC9_people_search",
    with_views("""SELECT contact_id, full_name, title FROM contacts WHERE string_split(email, '@')[2] IN ('mail3.example', 'mail7.example') AND (lower(title) LIKE '%chief executive officer%' OR lower(title) LIKE '%founder%')
 UNION ALL SELECT contact_id, full_name, title FROM contacts WHERE string_split(email, '@')[2] = 'mail9.example' AND lower(title) IN ('cto', 'vp engineering')"""),
)
def people_search(spark, sf_dir):
    """A search by domains and title parts, and the fall-back by whole titles for a domain where none fits: typed predicates."""
    c = model.contacts(spark, sf_dir).withColumn("_host", F.substring_index("email", "@", -1))
    wanted = F.lit(False)
    for part in ("chief executive officer", "founder"):
        wanted = wanted | F.lower("title").contains(part)
    strict = C("_host").isin("mail3.example", "mail7.example") & wanted
    fallback = (C("_host") == "mail9.example") & F.lower("title").isin("cto", "vp engineering")
    return c.where(strict | fallback).select("contact_id", "full_name", "title")


_ELEMENTS = [  # tags, seed: name, url, domain, city, snippet
    ({"name": " Acme ", "website": "acme.example", "addr:city": "Berlin", "office": "it", "phone": "123"}, ("Acme", "https://acme.example", "acme.example", "Berlin", "City: Berlin. Phone: 123. Type: office=it.")),
    ({"operator": "Globex", "contact:website": "http://www.globex.example/x", "addr:suburb": "Mitte"}, ("Globex", "http://www.globex.example/x", "globex.example", "Mitte", "City: Mitte. Type: office=company.")),
    ({"brand": "Initech", "website": "https://www.openstreetmap.org/1", "url": "https://initech.example", "contact:phone": "9"}, ("Initech", "https://initech.example", "initech.example", None, "Phone: 9. Type: office=company.")),
    ({"name": "No site"}, None),
    ({"website": "https://noname.example"}, None),
]
_SEED = ("name", "url", "domain", "city", "snippet")


def _seeds(df):
    tags = F.from_json("tags", "map<string,string>")
    some = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(k))), F.lit("")) for k in keys])
    sites = F.array_compact(F.array(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(k))), F.lit("")) for k in ("website", "contact:website", "url", "contact:url")]))
    site = F.get(F.filter(sites, lambda s: ~s.contains("openstreetmap.org")), F.lit(0))
    url = F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site))
    name, city, phone = some("name", "operator", "brand"), some("addr:city", "addr:place", "addr:suburb"), some("phone", "contact:phone")
    note = F.concat_ws(" ", F.concat(F.lit("City: "), city, F.lit(".")), F.concat(F.lit("Phone: "), phone, F.lit(".")), F.concat(F.lit("Type: office="), F.coalesce(some("office"), F.lit("company")), F.lit(".")))
    kept = name.isNotNull() & domain_of_url(url).isNotNull()
    return {c: F.when(kept, v) for c, v in zip(_SEED, (name, url, domain_of_url(url), city, note), strict=True)}


case_query("SRC10_map_elements", {"tags": [json.dumps(t) for t, _ in _ELEMENTS]}, _seeds, {c: [e[i] if e else None for _, e in _ELEMENTS] for i, c in enumerate(_SEED)})

_LINES = ['{0},"Acme, Inc.",HTTPS://www.Acme.example/x,Jane Doe,,Jane@Acme.Example', "{0},,acme.example,Bob,CTO,", '{0},"The ""Big"" One",,,Founder,x@y.example', "{0},Plain,http://plain.example:80,Ann,CEO,"]
_LEADS = [("Acme, Inc.", "acme.example", "Jane Doe", "Team Member", "jane@acme.example"), None, ('The "Big" One', None, "Unknown Contact", "Founder", "x@y.example"), ("Plain", "plain.example", "Ann", "CEO", None)]


@query(
    "SRC3_csv_leads",
    "SELECT e.* EXCLUDE k FROM customer JOIN (VALUES " + ", ".join("(" + ", ".join([str(k), *("NULL" if v is None else "'" + v + "'" for v in lead)]) + ")" for k, lead in enumerate(_LEADS) if lead) + ") e(k, company, domain, contact, title, email) ON c_custkey % 4 = k",
)
def csv_rows(spark, sf_dir):
    """Lines of a file, quotes and all; headers as people write them; rows without a company are left to the errors."""
    lines = cases(spark, sf_dir, {"line": _LINES}).select(F.replace("line", F.lit("{0}"), C("id").cast("string")).alias("line"))
    raw = lines.select(F.from_csv("line", F.lit("id string, `Company Name` string, Website string, `Full Name` string, Role string, `Email Address` string"), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    rows, _ = csv_leads.leads(raw)
    return rows.select("company", "domain", C("contactName").alias("contact"), "title", "email")


_ATTEMPTS = "SELECT user_id AS job, ts AS ran, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events"


@query(
    "STM1_job_attempts",
    f"""SELECT job, CASE WHEN bool_or(ok) THEN 'completed' WHEN count(*) = 2 THEN 'failed' ELSE 'waiting' END AS status, count(*) FILTER (NOT coalesce(earlier_ok, false)) AS attempts,
 CASE WHEN NOT bool_or(ok) AND count(*) = 1 THEN max(ran) + INTERVAL 2 SECOND END AS retry_at
 FROM (SELECT *, lag(ok) OVER (PARTITION BY job ORDER BY attempt) AS earlier_ok FROM ({_ATTEMPTS}) WHERE attempt <= 2) GROUP BY job""",
)
def job_attempts(spark, sf_dir):
    """Two attempts a job, the second two seconds after the first has failed, unless the first did it; one aggregate a job.

    The two earliest attempts come from a bounded sorted list of an aggregate, so a job with many events needs no window.
    """
    e = model.table(spark, sf_dir, "events").select(C("user_id").alias("job"), F.struct("ts", "event_id", (C("event_type") != "error").alias("ok")).alias("a"))
    first = e.groupBy("job").agg(F.min("a").alias("first"), F.count("*").alias("n"))
    second = e.join(first, "job").where(C("a") > C("first")).groupBy("job").agg(F.min("a").alias("second"))
    both = first.join(second, "job", "left")
    done_first, done_second = C("first.ok"), F.coalesce(C("second.ok"), F.lit(False))
    status = F.when(done_first | done_second, "completed").when(C("second").isNotNull(), "failed").otherwise("waiting")
    attempts = F.when(done_first | C("second").isNull(), F.lit(1)).otherwise(F.lit(2)).cast("long")
    return both.select("job", status.alias("status"), attempts.alias("attempts"), F.when(status == "waiting", C("first.ts") + F.expr("interval 2 seconds")).alias("retry_at"))


@query(
    "STM7_send_plan",
    with_views("""SELECT campaign_id, email_id, (row_number() OVER (PARTITION BY campaign_id ORDER BY email_id, status) - 1) * 400 AS offset_ms, status = 'sent' AS ok FROM emails"""),
)
def send_plan(spark, sf_dir):
    """When each mail of a campaign goes out, 400 ms after the one before.

    Campaigns are few and may be large, so places come from counts of ranges of email_id, not from one window a campaign.
    """
    mails = model.emails(spark, sf_dir).select("campaign_id", "email_id", (C("status") == "sent").alias("ok"))
    dealt = mails.withColumn("part", F.floor(C("email_id") / 4096))
    counts = dealt.groupBy("campaign_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("campaign_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("campaign_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("campaign_id", "part").orderBy("email_id", "ok"))
    ranked = dealt.withColumn("place", place).join(base, ["campaign_id", "part"])
    return ranked.select("campaign_id", "email_id", ((C("base") + C("place") - 1) * 400).alias("offset_ms"), "ok")


@query("AGG12_campaign_summary", with_views("SELECT CASE WHEN sent_count = 0 AND failed_count > 0 THEN 'failed' WHEN failed_count > 0 THEN 'partial' ELSE 'completed' END AS status, count(*) AS campaigns, CAST(sum(sent_count) AS BIGINT) AS sent, CAST(sum(failed_count) AS BIGINT) AS failed FROM campaigns GROUP BY ALL"))
def campaign_summary(spark, sf_dir):
    c = model.campaigns(spark, sf_dir).withColumn("status", rules.campaign_status(C("sent_count"), C("failed_count")))
    return c.groupBy("status").agg(F.count("*").alias("campaigns"), F.sum("sent_count").alias("sent"), F.sum("failed_count").alias("failed"))


_EVENTS = {  # kind: table, id, title, when it counts, in SQL as well
    "search_created": ("searches", "search_id", "name", "true"),
    "search_completed": ("searches", "search_id", "name", "status = 'completed'"),
    "company_found": ("companies", "company_id", "name", "true"),
    "contact_enriched": ("contacts", "contact_id", "full_name", "enriched_at IS NOT NULL"),
    "contact_scored": ("contacts", "contact_id", "full_name", "lead_score IS NOT NULL"),
    "email_written": ("emails", "email_id", "tone", "true"),
    "email_sent": ("emails", "email_id", "tone", "status = 'sent'"),
    "reply_received": ("emails", "email_id", "tone", "reply_status = 'replied'"),
    "campaign_run": ("campaigns", "campaign_id", "name", "true"),
}
_UNION = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({key} AS BIGINT) AS id, CAST({title} AS VARCHAR) AS title FROM {table} WHERE {test}" for kind, (table, key, title, test) in _EVENTS.items())


@query(
    "SET1_event_union",
    with_views(f"{_UNION} UNION ALL SELECT 'follow_up_scheduled', CAST(follow_up_id AS BIGINT), status FROM follow_ups UNION ALL SELECT 'follow_up_' || status, CAST(follow_up_id AS BIGINT), status FROM follow_ups WHERE status IN ('sent', 'cancelled')"),
)
def event_union(spark, sf_dir):
    """Unlike tables in one layout; a follow-up gives a row when it is planned and one more when it is done or cancelled."""
    tables = {name: getattr(model, name)(spark, sf_dir) for name in {t for t, *_ in _EVENTS.values()}}
    out = None
    for kind, (name, key, title, test) in _EVENTS.items():
        rows = tables[name].where(F.expr(test)).select(F.lit(kind).alias("kind"), C(key).cast("long").alias("id"), C(title).alias("title"))
        out = rows if out is None else out.union(rows)
    later = F.when(C("status").isin("sent", "cancelled"), F.concat(F.lit("follow_up_"), C("status")))
    kinds = F.explode(F.array_compact(F.array(F.lit("follow_up_scheduled"), later)))
    return out.union(model.follow_ups(spark, sf_dir).select(kinds.alias("kind"), C("follow_up_id").cast("long").alias("id"), C("status").alias("title")))

"""Queries over joins, windows, sorts, set operations and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query
from ..sources import model
from ..sources.model import with_views


@query("SRC1_scan_projection", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL")
def scan(spark, sf_dir):
    return model.table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_acctbal").isNotNull()).select("c_custkey", "c_name")


@query(
    "SRC2_embedded_lookup",
    with_views("SELECT email_id, coalesce(full_name, '') || ' <' || coalesce(email, '') || '>' AS contact, name AS company FROM emails LEFT JOIN contacts USING (contact_id) LEFT JOIN companies USING (company_id) WHERE status = 'sent'"),
)
def embedded(spark, sf_dir):
    """A mail with its contact and, in that, the contact's company: to-one rows as nested values, absent ones as nulls."""
    company = model.companies(spark, sf_dir).select("company_id", F.struct("name", "domain").alias("company"))
    contact = model.contacts(spark, sf_dir).join(company, "company_id", "left").select("contact_id", F.struct("full_name", "email", "company").alias("contact"))
    rows = model.emails(spark, sf_dir).where("status = 'sent'").select("email_id", "contact_id").join(contact, "contact_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("email_id", F.concat(some("contact.full_name"), F.lit(" <"), some("contact.email"), F.lit(">")).alias("contact"), F.col("contact.company.name").alias("company"))


@query("JN1_contact_company", with_views("SELECT contact_id, full_name, name AS company, domain FROM contacts LEFT JOIN companies USING (company_id)"))
def contact_company(spark, sf_dir):
    return R.contact_companies(model.contacts(spark, sf_dir), model.companies(spark, sf_dir)).select("contact_id", "full_name", "company", "domain")


@query("JN2_recipients", with_views("SELECT email_id, coalesce(email, '') AS recipient, full_name FROM emails LEFT JOIN contacts USING (contact_id) WHERE status = 'draft'"))
def recipients(spark, sf_dir):
    return R.recipients(model.emails(spark, sf_dir).where("status = 'draft'"), model.contacts(spark, sf_dir)).select("email_id", F.coalesce("email", F.lit("")).alias("recipient"), "full_name")


@query("JN3_follow_up_context", with_views("SELECT follow_up_id, full_name, e.status AS mail_status FROM follow_ups f LEFT JOIN contacts c ON f.contact_id = c.contact_id LEFT JOIN emails e ON f.source_email_id = e.email_id"))
def follow_up_context(spark, sf_dir):
    mails = model.emails(spark, sf_dir).select(F.col("email_id").alias("source_email_id"), F.col("status").alias("mail_status"))
    return model.follow_ups(spark, sf_dir).join(model.contacts(spark, sf_dir).select("contact_id", "full_name"), "contact_id", "left").join(mails, "source_email_id", "left").select("follow_up_id", "full_name", "mail_status")


@query("JN4_contact_intent", with_views("SELECT contact_id, coalesce(intent, 0) AS intent FROM contacts LEFT JOIN (SELECT company_id, confidence AS intent FROM companies WHERE confidence >= 70) USING (company_id)"))
def contact_intent(spark, sf_dir):
    intent = model.companies(spark, sf_dir).where("confidence >= 70").select("company_id", F.col("confidence").alias("intent"))
    return model.contacts(spark, sf_dir).join(intent, "company_id", "left").select("contact_id", F.coalesce("intent", F.lit(0)).alias("intent"))


@query("JN5_active_contacts", with_views("SELECT contact_id FROM contacts WHERE company_id IN (SELECT company_id FROM companies WHERE search_id IN (SELECT search_id FROM searches WHERE status IN ('active', 'completed')))"))
def active_contacts(spark, sf_dir):
    return R.active_contacts(model.contacts(spark, sf_dir), model.companies(spark, sf_dir), model.searches(spark, sf_dir)).select("contact_id")


@query("JN6_not_paused", with_views("SELECT email_id FROM emails WHERE contact_id NOT IN (SELECT contact_id FROM contacts WHERE paused)"))
def not_paused(spark, sf_dir):
    return R.without_paused(model.emails(spark, sf_dir), model.contacts(spark, sf_dir)).select("email_id")


@query("FLT27_outreach_guard", with_views("SELECT email_id FROM emails WHERE status = 'draft' AND contact_id NOT IN (SELECT contact_id FROM contacts WHERE paused)"))
def outreach_guard(spark, sf_dir):
    return R.without_paused(model.emails(spark, sf_dir).where("status = 'draft'"), model.contacts(spark, sf_dir)).select("email_id")


@query("JN7_uncovered", with_views("SELECT company_id, name FROM companies WHERE company_id NOT IN (SELECT company_id FROM contacts WHERE confidence >= 95)"))
def uncovered(spark, sf_dir):
    return R.uncovered(model.companies(spark, sf_dir), model.contacts(spark, sf_dir).where("confidence >= 95")).select("company_id", "name")


def _keyed(spark, sf_dir):
    return model.companies(spark, sf_dir).select("company_id", F.concat(F.lit("k"), F.col("company_id") % 400).alias("dedup_key"))


_KEYED = "SELECT company_id, 'k' || (company_id % 400) AS dedup_key FROM companies"


@query("JN8_mark_known", with_views(f"SELECT company_id, dedup_key, dedup_key IN (SELECT dedup_key FROM ({_KEYED}) WHERE company_id % 9 = 0) AS known FROM ({_KEYED})"))
def mark_known(spark, sf_dir):
    return R.mark_known(_keyed(spark, sf_dir), _keyed(spark, sf_dir).where("company_id % 9 = 0"), "dedup_key").select("company_id", "dedup_key", "known")


@query("JN9_selected", with_views("SELECT company_id, name FROM companies WHERE company_id IN (3, 5, 8, 13, 21)"))
def selected(spark, sf_dir):
    return model.companies(spark, sf_dir).where(F.col("company_id").isin(3, 5, 8, 13, 21)).select("company_id", "name")


def _seeds(spark, sf_dir, rest):
    key = F.col("company_id")
    return model.companies(spark, sf_dir).where(F.col("domain").isNotNull() & (key % 3 != rest)).select("domain", F.concat("name", F.lit(f" {rest}")).alias("title"), F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("about "), "name")).alias("snippet"), key.alias("ord"))


_SEED = "SELECT domain, name || ' {0}' AS title, CASE WHEN company_id % 2 = 0 THEN '' ELSE 'about ' || name END AS snippet, company_id AS ord FROM companies WHERE domain IS NOT NULL AND company_id % 3 <> {0}"
_MERGED = f"""SELECT coalesce(d.domain, w.domain) AS domain, coalesce(d.title, w.title) AS title, coalesce(nullif(d.snippet, ''), w.snippet) AS snippet,
 CASE WHEN d.ord IS NOT NULL THEN 'directory' ELSE 'web' END AS source, coalesce(d.ord, w.ord) AS ord FROM ({_SEED.format(1)}) d FULL JOIN ({_SEED.format(2)}) w ON d.domain = w.domain"""


@query(
    "SET3_distinct_seeds",
    with_views(f"""SELECT domain, title, source FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source, ord) AS nth FROM (SELECT 'directory' AS source, * FROM ({_SEED.format(1)}) UNION ALL SELECT 'web', * FROM ({_SEED.format(2)}))) WHERE nth = 1"""),
)
def distinct_seeds(spark, sf_dir):
    """Union of both sources, the first of a domain whole and unmerged: an aggregate that combines before the shuffle."""
    both = _seeds(spark, sf_dir, 1).withColumn("source", F.lit("directory")).union(_seeds(spark, sf_dir, 2).withColumn("source", F.lit("web")))
    return both.groupBy("domain").agg(F.min(F.struct("source", "ord", "title")).alias("m")).select("domain", "m.title", "m.source")


@query("JN10_merge_seeds", with_views(_MERGED))
def merge_seeds(spark, sf_dir):
    return R.merge_seeds(_seeds(spark, sf_dir, 1), _seeds(spark, sf_dir, 2))


@query("SRT5_directory_first", with_views(f"SELECT domain, source FROM ({_MERGED}) ORDER BY source, ord LIMIT 20"))
def directory_first(spark, sf_dir):
    return R.merge_seeds(_seeds(spark, sf_dir, 1), _seeds(spark, sf_dir, 2)).orderBy("source", "ord").limit(20).select("domain", "source")


def _events(spark, sf_dir):
    return model.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


@query(
    "JN13_first_reply",
    """SELECT mail_id, reply_id FROM (SELECT m.event_id AS mail_id, r.event_id AS reply_id, row_number() OVER (PARTITION BY m.event_id ORDER BY r.ts, r.event_id) AS nth
 FROM events m JOIN events r ON m.user_id = r.user_id AND r.ts > m.ts WHERE m.event_type = 'purchase' AND r.event_type = 'signup') WHERE nth = 1""",
)
def first_reply(spark, sf_dir):
    e = _events(spark, sf_dir)
    sent = e.where("event_type = 'purchase'").select(F.col("event_id").alias("mail_id"), F.col("user_id").alias("person"), F.col("ts").alias("sent_at"))
    return R.replies_to_mails(e.where("event_type = 'signup'").select(F.col("event_id").alias("reply_id"), F.col("user_id").alias("person"), F.col("ts").alias("reply_at")), sent)


@query("WIN1_first_per_key", with_views(f"SELECT min(company_id) AS company_id, dedup_key FROM ({_KEYED}) GROUP BY dedup_key"))
def first_per_key(spark, sf_dir):
    return R.first_per_key(_keyed(spark, sf_dir), F.col("dedup_key"), ["company_id"]).select("company_id", "dedup_key")


@query(
    "AGG18_discovery_counters",
    with_views(f"""SELECT count(*) FILTER (nth = 1) AS kept, count(*) FILTER (nth > 1) AS batch_duplicates, count(*) FILTER (nth = 1 AND known) AS known_duplicates, count(*) FILTER (nth > 1) AS dropped
 FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY company_id) AS nth, dedup_key IN (SELECT dedup_key FROM ({_KEYED}) WHERE company_id % 9 = 0) AS known FROM ({_KEYED}))"""),
)
def discovery_counters(spark, sf_dir):
    return R.dedup_counters(_keyed(spark, sf_dir), _keyed(spark, sf_dir).where("company_id % 9 = 0"), "dedup_key")


@query("WIN2_cap_per_company", with_views("SELECT company_id, contact_id, nth FROM (SELECT company_id, contact_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY contact_id) AS INTEGER) AS nth FROM contacts) WHERE nth <= 5"))
def cap_per_company(spark, sf_dir):
    return R.cap_per_group(model.contacts(spark, sf_dir).select("company_id", "contact_id"), "company_id", ["contact_id"], 5)


@query("WIN3_best_per_key", with_views("SELECT country, name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY confidence DESC, company_id) AS nth FROM companies) WHERE nth = 1"))
def best_per_key(spark, sf_dir):
    rows = model.companies(spark, sf_dir)
    return R.best_per_key(rows, ["country"], [F.col("confidence").alias("rank"), (-F.col("company_id")).alias("tie")], ["name", "confidence"])


_MAIL4 = """SELECT contact_id, company_id, CASE WHEN nth = 1 THEN email END AS email, CASE WHEN nth = 1 THEN 'email' WHEN linkedin_url <> '' THEN 'linkedin' END AS channel
 FROM (SELECT *, CASE WHEN email <> '' THEN row_number() OVER (PARTITION BY company_id, email ORDER BY contact_id) END AS nth FROM contacts)"""


@query("WIN4_distinct_mail", with_views(_MAIL4))
def distinct_mail(spark, sf_dir):
    return R.distinct_mail_per_company(model.contacts(spark, sf_dir))


@query("LEAD1_finalize", with_views(f"SELECT contact_id, channel, CASE WHEN channel IS NULL THEN 'discarded' ELSE 'kept' END AS fate FROM ({_MAIL4})"))
def finalize(spark, sf_dir):
    return R.distinct_mail_per_company(model.contacts(spark, sf_dir)).select("contact_id", "channel", F.when(F.col("channel").isNull(), "discarded").otherwise("kept").alias("fate"))


@query("WIN6_domain_distinct_quota", with_views(f"SELECT domain, ord FROM (SELECT domain, min(ord) AS ord FROM ({_SEED.format(1)} UNION ALL {_SEED.format(2)}) GROUP BY domain) ORDER BY ord LIMIT 25"))
def domain_distinct(spark, sf_dir):
    both = _seeds(spark, sf_dir, 1).union(_seeds(spark, sf_dir, 2))
    return both.groupBy("domain").agg(F.min("ord").alias("ord")).orderBy("ord").limit(25)


@query("WIN7_url_distinct", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def url_distinct(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


_PAGES = "SELECT company_id, name || ' {0}' AS name FROM companies WHERE company_id % 3 <> {0}"


@query("WIN8_page_merge", with_views(f"SELECT * FROM ({_PAGES.format(1)}) UNION ALL SELECT * FROM ({_PAGES.format(2)}) WHERE company_id NOT IN (SELECT company_id FROM ({_PAGES.format(1)}))"))
def page_merge(spark, sf_dir):
    part = lambda k: model.companies(spark, sf_dir).where(F.col("company_id") % 3 != k).select("company_id", F.concat("name", F.lit(f" {k}")).alias("name"))
    return R.union_first(part(1), part(2), ["company_id"], ["name"])


@query("SET2_union_distinct", with_views("SELECT company_id, lower(full_name) AS name, min(contact_id) AS contact_id FROM contacts GROUP BY ALL"))
def union_distinct(spark, sf_dir):
    c = model.contacts(spark, sf_dir).select("company_id", F.lower("full_name").alias("name"), "contact_id")
    return c.groupBy("company_id", "name").agg(F.min("contact_id").alias("contact_id"))


@query("WIN9_best_source", with_views("SELECT company_id, max_by(email, (CASE email_status WHEN 'valid' THEN 3 WHEN 'catch_all' THEN 2 ELSE 1 END) * 100000000 - contact_id) AS email FROM contacts WHERE email <> '' GROUP BY company_id"))
def best_source(spark, sf_dir):
    rank = F.when(F.col("email_status") == "valid", 3).when(F.col("email_status") == "catch_all", 2).otherwise(1)
    return model.contacts(spark, sf_dir).where("email <> ''").groupBy("company_id").agg(F.max_by("email", F.struct(rank, -F.col("contact_id"))).alias("email"))


@query("SRT1_company_rank", with_views("SELECT company_id, confidence FROM companies ORDER BY confidence DESC, employee_count DESC NULLS LAST, company_id"))
def company_rank(spark, sf_dir):
    return model.companies(spark, sf_dir).orderBy(F.desc("confidence"), F.desc_nulls_last("employee_count"), "company_id").select("company_id", "confidence")


@query("SRT3_contact_rank", with_views("SELECT contact_id, full_name, confidence FROM contacts ORDER BY confidence DESC, full_name, contact_id"))
def contact_rank(spark, sf_dir):
    return model.contacts(spark, sf_dir).select("contact_id", "full_name", "confidence").orderBy(F.desc("confidence"), "full_name", "contact_id")


@query("SRT7_quotas", with_views("""SELECT company_id, country, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY company_id) AS nth, length(country) AS w FROM companies)
 JOIN (SELECT country, greatest(1, ceil(w / sum(w) OVER () * 40)) AS quota FROM (SELECT DISTINCT country, length(country) AS w FROM companies)) USING (country) WHERE nth <= quota"""))
def quotas(spark, sf_dir):
    rows = model.companies(spark, sf_dir).select("company_id", "country", F.length("country").alias("weight"))
    return R.quotas(rows, "country", "weight", 40, ["company_id"]).select("company_id", "country", "nth")


@query("SRT8_ui_sorts", with_views("SELECT company_id, name FROM companies ORDER BY name, company_id"))
def ui_sorts(spark, sf_dir):
    return model.companies(spark, sf_dir).orderBy("name", "company_id").select("company_id", "name")


@query("SRT9_page", with_views("SELECT company_id, name FROM companies ORDER BY confidence DESC, company_id LIMIT 20 OFFSET 40"))
def page(spark, sf_dir):
    return R.page(model.companies(spark, sf_dir), [F.desc("confidence"), "company_id"], 3, 20, [-F.col("confidence"), F.col("company_id")]).select("company_id", "name")


@query("SRT9_page_by_rank", with_views("SELECT contact_id, full_name FROM contacts ORDER BY confidence DESC, contact_id LIMIT 50 OFFSET 10450"))
def page_by_rank(spark, sf_dir):
    """The 210th page of the contacts, by rank; empty where there are fewer."""
    return R.page(model.contacts(spark, sf_dir), [F.desc("confidence"), "contact_id"], 210, 50, [-F.col("confidence"), F.col("contact_id")]).select("contact_id", "full_name")


@query("SRT9_page_info", with_views("SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages, 3 < greatest(1, ceil(count(*) / 20.0)) AS has_more FROM companies"))
def page_info(spark, sf_dir):
    return R.page_info(model.companies(spark, sf_dir), 3, 20)


@query("SRT10_searches_by_update", with_views("SELECT search_id, name FROM searches ORDER BY updated_ord DESC NULLS FIRST, search_id"))
def searches_by_update(spark, sf_dir):
    return model.searches(spark, sf_dir).orderBy(F.desc_nulls_first("updated_ord"), "search_id").select("search_id", "name")


@query("SET5_array_sets", "SELECT p_partkey AS search_id, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS keywords FROM part")
def array_sets(spark, sf_dir):
    return model.searches(spark, sf_dir).select("search_id", F.array_join(F.array_sort(F.array_distinct("keywords")), " ").alias("keywords"))


@query("SET4_semi_anti", with_views("SELECT company_id FROM companies WHERE company_id IN (SELECT company_id FROM contacts WHERE channel = 'email') AND company_id NOT IN (SELECT company_id FROM contacts WHERE paused)"))
def semi_anti(spark, sf_dir):
    c = model.contacts(spark, sf_dir)
    return model.companies(spark, sf_dir).select("company_id").join(c.where("channel = 'email'").select("company_id"), "company_id", "left_semi").join(c.where("paused").select("company_id"), "company_id", "left_anti")


@query("SNK1_upsert", with_views("""SELECT company_id, coalesce(b.name, a.name) AS name, CASE WHEN a.company_id IS NOT NULL THEN a.confidence ELSE b.confidence END AS confidence
 FROM (SELECT company_id, name, confidence FROM companies WHERE company_id % 3 <> 0) a FULL JOIN (SELECT company_id, name || ' new' AS name, confidence + 1 AS confidence FROM companies WHERE company_id % 2 = 0) b USING (company_id)"""))
def upsert(spark, sf_dir):
    c = model.companies(spark, sf_dir).select("company_id", "name", "confidence")
    return R.upsert(c.where("company_id % 3 <> 0"), c.where("company_id % 2 = 0").select("company_id", F.concat("name", F.lit(" new")).alias("name"), (F.col("confidence") + 1).alias("confidence")), ["company_id"], ["confidence"])


@query("SNK2_guarded_update", with_views("SELECT follow_up_id, CASE WHEN status = 'scheduled' AND suggested THEN 'cancelled' ELSE status END AS status FROM follow_ups"))
def guarded_update(spark, sf_dir):
    return R.guarded_update(model.follow_ups(spark, sf_dir).select("follow_up_id", "status", "suggested"), (F.col("status") == "scheduled") & F.col("suggested"), {"status": F.lit("cancelled")}).drop("suggested")


@query("SNK3_soft_delete", with_views("SELECT contact_id, discarded OR confidence < 10 AS discarded, CASE WHEN confidence >= 10 THEN email END AS email, CASE WHEN confidence >= 10 THEN lead_score END AS lead_score FROM contacts"))
def soft_delete(spark, sf_dir):
    return R.soft_delete(model.contacts(spark, sf_dir), F.col("confidence") < 10).select("contact_id", "discarded", "email", "lead_score")


_LABELS = {"signup": "Signed up", "purchase": "Bought", "click": "Clicked"}


@query(
    "SRT11_activity_feed",
    """SELECT id, kind, day FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id) AS nth FROM (SELECT event_id AS id, event_type AS kind, ts, strftime(ts, '%Y-%m-%d') AS day FROM events))
 WHERE nth <= 8 ORDER BY ts DESC, id LIMIT 20""",
)
def activity_feed(spark, sf_dir):
    """Each source gives its newest eight through a top-k, so only a few rows are merged."""
    e = _events(spark, sf_dir)
    parts = [e.where(F.col("event_type") == kind).orderBy(F.desc("ts"), "event_id").limit(8) for kind in ("signup", "purchase", "view", "click", "error")]
    feed = parts[0]
    for part in parts[1:]:
        feed = feed.unionByName(part)
    return feed.orderBy(F.desc("ts"), "event_id").limit(20).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("FLT28_email_lead", with_views("SELECT contact_id FROM contacts WHERE enriched_at IS NOT NULL AND (channel = 'email' OR (channel IS NULL AND email <> ''))"))
def email_leads(spark, sf_dir):
    from ..operators.metrics import email_lead

    return model.contacts(spark, sf_dir).where(email_lead()).select("contact_id")


@query("STM5_rate_gaps", "SELECT event_id, CAST(floor(epoch(ts)) - floor(epoch(before)) AS BIGINT) AS gap FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND floor(epoch(ts)) - floor(epoch(before)) < 3600")
def rate_gaps(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    rows = _events(spark, sf_dir).withColumn("before", before).where("before is not null")
    return rows.select("event_id", (seconds(F.col("ts")) - seconds(F.col("before"))).alias("gap")).where("gap < 3600")

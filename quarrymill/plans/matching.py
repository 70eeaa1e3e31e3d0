"""Queries over titles, countries, validation with reasons, relaxed tiers, fit, dates, caches and CSV."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import countries, rules, text, titles
from ..registry import query
from ..sources import csv_leads, model
from ..sources.model import with_views
from .functions import _TEXT, _TYPE, C, _chain, _has, _match_sql, _projection


def _title_sql(wanted: list[str]) -> str:
    single, several = titles.role_pattern(wanted)
    held = " OR ".join([_has("t", single)] * bool(single) + [f"contains(t, '{r}')" for r in several] + ([_has("t", titles.VP_ENGINEERING)] if any("vp engineering" in w.lower() for w in wanted) else []))
    barred = f"{_has('t', titles.NO_DECISION)} OR ({_has('t', titles.NO_EXECUTIVE)} AND NOT {_has('t', titles.STILL_EXECUTIVE)})"
    if "manager" in [w.lower() for w in wanted]:
        barred += f" OR ({_has('t', '\\bmanager\\b')} AND NOT {_has('t', titles.EXECUTIVE_MANAGERS)})"
    unknown = ", ".join(f"'{t}'" for t in titles.UNKNOWN_TITLES)
    return f"(SELECT t NOT IN ({unknown}) AND NOT ({barred}) AND ({held}) FROM (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t))"


_projection("FLT15_title_match", "contacts", "contact_id", {f"is_{w[0].lower().replace(' ', '_').replace('-', '_')}": (lambda w=w: titles.title_matches(C("title"), w), _title_sql(w)) for w in (["CEO"], ["CTO"], ["VP Engineering"], ["Manager"], ["Founder", "Director"])})
_RANK = _chain("title", titles.DECISION_RANKS, "0")


@query("SRT4_decision_rank", with_views(f"SELECT contact_id, full_name, {_RANK} AS rank FROM contacts ORDER BY {_RANK} DESC, full_name, contact_id"))
def decision_rank(spark, sf_dir):
    return model.contacts(spark, sf_dir).select("contact_id", "full_name", titles.decision_rank(C("title")).alias("rank")).orderBy(F.desc("rank"), "full_name", "contact_id")


@query(
    "FLT17_title_filter",
    with_views(f"""SELECT company_id, contact_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tier, rank DESC, full_name, contact_id) AS nth
 FROM (SELECT *, CASE WHEN {_title_sql(["CTO"])} THEN 1 WHEN {_title_sql(["CEO", "Founder"])} THEN 2 END AS tier, {_RANK} AS rank FROM contacts) WHERE tier IS NOT NULL) WHERE nth <= 5"""),
)
def title_filter(spark, sf_dir):
    """Exact titles first, then executives; five of a company."""
    tier = F.when(titles.title_matches(C("title"), ["CTO"]), 1).when(titles.title_matches(C("title"), ["CEO", "Founder"]), 2)
    rows = model.contacts(spark, sf_dir).select("company_id", "contact_id", "full_name", tier.alias("tier"), titles.decision_rank(C("title")).alias("rank")).where("tier is not null")
    order = Window.partitionBy("company_id").orderBy("tier", F.desc("rank"), "full_name", "contact_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth <= 5").select("company_id", "contact_id", "tier")


_GERMAN = "coalesce(contains(lower(concat_ws(' ', nullif(description, ''), nullif(domain, ''))), 'germany') OR contains(lower(concat_ws(' ', nullif(description, ''), nullif(domain, ''))), 'de'), false)"
_projection("FLT2_country", "companies", "company_id", {"germany": (lambda: countries.matches(C("country"), "Germany", C("domain"), C("description")), _GERMAN), "nation": (lambda: countries.matches(C("country"), "NATION_2", C("domain"), C("description")), "contains(lower(country), 'nation_2') OR contains('nation_2', lower(country))")})
_projection("FLT14_foreign", "companies", "company_id", {"foreign_seed": (lambda: ~countries.matches(C("country"), "NATION_2", C("domain"), F.lit("")), "NOT (contains(lower(country), 'nation_2') OR contains('nation_2', lower(country)))")})

_VALID = f"""SELECT company_id, concat_ws(';', CASE WHEN kind IN ('vc', 'accelerator', 'investment_firm', 'news_media', 'community') THEN 'company type' END, CASE WHEN m.score < 0.5 THEN 'industry' END,
 CASE WHEN country <> 'NATION_3' THEN 'country' END, CASE WHEN employee_count NOT BETWEEN 50 AND 500 THEN 'size' END) AS reasons, employee_count IS NULL AS size_unknown, m.score AS industry_score, confidence, domain
 FROM (SELECT *, {_TYPE} AS kind FROM companies) JOIN ({_match_sql('technology')}) m USING (company_id)"""


def validated(spark, sf_dir):
    """Every reason against a company, in order; an unknown size is a warning, not a reason."""
    rows = rules.with_industry_match(model.companies(spark, sf_dir), "technology").withColumn("_text", rules.company_text()).withColumn("kind", rules.company_type(C("_text"), C("domain")))
    reasons = F.array_compact(
        F.array(
            F.when(C("kind").isin("vc", "accelerator", "investment_firm", "news_media", "community"), "company type"),
            F.when(C("m.score") < 0.5, "industry"),
            F.when(C("country") != "NATION_3", "country"),
            F.when(C("employee_count").isNotNull() & ~rules.size_matches(C("employee_count"), 50, 500), "size"),
        )
    )
    return rows.select("company_id", F.array_join(reasons, ";").alias("reasons"), C("employee_count").isNull().alias("size_unknown"), C("m.score").alias("industry_score"), "confidence", "domain")


@query("FLT10_validation", with_views(f"SELECT company_id, reasons, size_unknown, reasons = '' AS accepted FROM ({_VALID})"))
def validation(spark, sf_dir):
    return validated(spark, sf_dir).select("company_id", "reasons", "size_unknown", (C("reasons") == "").alias("accepted"))


#: What no tier takes; it sorts last and goes after the window, as a filter before it would repeat every test of a tier.
NO_TIER = 4


@query(
    "FLT11_relaxed_tiers",
    with_views(f"""SELECT company_id, tier, tier > 0 AS relaxed FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(domain, 'id' || company_id) ORDER BY tier, confidence DESC, company_id) AS nth
 FROM (SELECT *, CASE WHEN reasons = '' THEN 0 WHEN industry_score >= 0.12 THEN 1 WHEN reasons IN ('industry', 'country', 'size') THEN 2 WHEN industry_score >= 0.1 THEN 3 END AS tier FROM ({_VALID})) WHERE tier IS NOT NULL)
 WHERE nth = 1 ORDER BY tier, confidence DESC, company_id"""),
)
def relaxed_tiers(spark, sf_dir):
    """Companies by the tier that takes them: accepted ones first, then those that a relaxed rule lets in."""
    tier = F.when(C("reasons") == "", 0).when(C("industry_score") >= 0.12, 1).when(C("reasons").isin("industry", "country", "size"), 2).when(C("industry_score") >= 0.1, 3).otherwise(NO_TIER)
    rows = validated(spark, sf_dir).select("company_id", "domain", "confidence", tier.alias("tier"))
    one = Window.partitionBy(F.coalesce("domain", F.concat(F.lit("id"), "company_id"))).orderBy("tier", F.desc("confidence"), "company_id")
    return rows.withColumn("nth", F.row_number().over(one)).where((C("nth") == 1) & (C("tier") < NO_TIER)).orderBy("tier", F.desc("confidence"), "company_id").select("company_id", "tier", (C("tier") > 0).alias("relaxed"))


_FIT = f"""SELECT company_id, CAST(least(100, floor(m.score * 28 + 0.5) + CASE WHEN contains({_TEXT}, 'software') THEN 18 ELSE 9 END + CASE WHEN country = 'NATION_3' THEN 18 ELSE 5 END
 + CASE WHEN employee_count IS NULL THEN 5 WHEN employee_count BETWEEN 50 AND 500 THEN 14 ELSE 0 END + floor(least(1, confidence / 100.0) * 12 + 0.5) + CASE WHEN linkedin_url <> '' THEN 5 ELSE 3 END + CASE WHEN m.score >= 0.5 THEN 5 ELSE 2 END) AS BIGINT) AS fit
 FROM companies JOIN ({_match_sql('technology')}) m USING (company_id)"""


def fit(spark, sf_dir):
    """Each factor is rounded by itself, then they add up to 100 at most."""
    up = lambda c: F.floor(c + 0.5)
    size = F.when(C("employee_count").isNull(), up(F.lit(0.35 * 14))).when(rules.size_matches(C("employee_count"), 50, 500), 14).otherwise(0)
    total = up(C("m.score") * 28) + F.when(rules.company_text().contains("software"), 18).otherwise(9) + F.when(C("country") == "NATION_3", 18).otherwise(5) + size + up(F.least(F.lit(1.0), C("confidence") / 100.0) * 12) + F.when(C("linkedin_url") != "", 5).otherwise(3) + F.when(C("m.score") >= 0.5, 5).otherwise(2)
    return rules.with_industry_match(model.companies(spark, sf_dir), "technology").select("company_id", F.least(F.lit(100), total).cast("long").alias("fit"), "confidence")


@query("SCO4_company_fit", with_views(_FIT))
def company_fit(spark, sf_dir):
    return fit(spark, sf_dir).select("company_id", "fit")


@query("SRT2_seed_rank", with_views(f"SELECT company_id, rank FROM (SELECT company_id, fit + 0.25::DOUBLE * confidence + CASE company_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 0 END AS rank FROM ({_FIT}) JOIN companies USING (company_id)) ORDER BY rank DESC, company_id"))
def seed_rank(spark, sf_dir):
    rank = C("fit") + 0.25 * C("confidence") + F.when(C("company_id") % 3 == 0, 8).when(C("company_id") % 3 == 1, 4).otherwise(0)
    return fit(spark, sf_dir).select("company_id", rank.alias("rank")).orderBy(F.desc("rank"), "company_id")


@query("SRT6_listing_rank", with_views("SELECT company_id, name, confidence FROM companies ORDER BY confidence DESC, name, company_id"))
def listing_rank(spark, sf_dir):
    return model.companies(spark, sf_dir).orderBy(F.desc("confidence"), "name", "company_id").select("company_id", "name", "confidence")


@query("WIN5_stage_ratio", with_views("SELECT status, n, lag(n) OVER (ORDER BY status) AS before FROM (SELECT status, count(*) AS n FROM follow_ups GROUP BY status)"))
def stage_ratio(spark, sf_dir):
    counts = model.follow_ups(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("before", F.lag("n").over(Window.partitionBy(F.lit(1)).orderBy("status")))  # four rows


_SHOWN = "CASE WHEN email_status = 'valid' THEN 'verified' WHEN email_status = 'invalid' THEN 'invalid' WHEN email_status = 'catch_all' THEN 'risky' WHEN email_status IS NOT NULL THEN 'likely_valid' END"


@query("AGG16_verification_summary", with_views(f"SELECT count(*) FILTER (display = 'verified') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (display IN ('likely_valid', 'risky')) AS risky, count(*) FILTER (status = 'no_email') AS skipped FROM (SELECT CASE WHEN coalesce(email, '') = '' THEN 'no_email' ELSE email_status END AS status, CASE WHEN email <> '' THEN {_SHOWN} END AS display FROM contacts)"))
def verification_summary(spark, sf_dir):
    from ..operators.metrics import filled
    from ..operators.metrics import verification_summary as summary

    there = filled(C("email"))
    display = F.when(C("email_status") == "valid", "verified").when(C("email_status") == "invalid", "invalid").when(C("email_status") == "catch_all", "risky").when(C("email_status").isNotNull(), "likely_valid")
    return summary(model.contacts(spark, sf_dir).select(F.when(there, C("email_status")).otherwise("no_email").alias("status"), F.when(there, display).alias("display")))


_projection("CLS7_verification", "contacts", "contact_id", {"status": (lambda: F.when(~F.coalesce(C("email") != "", F.lit(False)), "no_email").when(~text.email_ok(C("email")), "invalid_syntax").when(C("company_id") % 7 == 0, "invalid_domain").when(C("email_status").isNull(), "unknown").otherwise(C("email_status")), f"CASE WHEN NOT coalesce(email <> '', false) THEN 'no_email' WHEN NOT regexp_matches(email, '^[a-z0-9.]+@[a-z0-9.]+$') THEN 'invalid_syntax' WHEN company_id % 7 = 0 THEN 'invalid_domain' WHEN email_status IS NULL THEN 'unknown' ELSE email_status END")})
_projection("DATE_days_between", "orders", "o_orderkey", {"days": (lambda: F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit("1999-01-01").cast("timestamp")) - F.unix_timestamp(C("o_orderdate").cast("timestamp"))) / 86400)), "greatest(0, CAST(floor((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT))"), "due": (lambda: F.date_format(C("o_orderdate") + F.expr("interval 3 days"), "yyyy-MM-dd"), "strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d')")})


@query("STM3_schedule", with_views("SELECT email_id, strftime(sent_at + INTERVAL 3 DAY, '%Y-%m-%d') AS due_on FROM emails WHERE status = 'sent' AND reply_status = 'none' AND contact_id NOT IN (SELECT contact_id FROM contacts WHERE paused)"))
def scheduled(spark, sf_dir):
    from ..operators.relational import without_paused

    sent = model.emails(spark, sf_dir).where("status = 'sent' and reply_status = 'none'")
    return without_paused(sent, model.contacts(spark, sf_dir)).select("email_id", F.date_format(C("sent_at") + F.expr("interval 3 days"), "yyyy-MM-dd").alias("due_on"))


@query("STM2_reply_cancels", with_views("SELECT follow_up_id, CASE WHEN status = 'scheduled' AND source_email_id IN (SELECT email_id FROM emails WHERE reply_status = 'replied') THEN 'cancelled' ELSE status END AS status FROM follow_ups"))
def reply_cancels(spark, sf_dir):
    from ..streaming.follow_ups import cancel

    found = model.emails(spark, sf_dir).where("reply_status = 'replied'").select(C("email_id").alias("mail_id"))
    return cancel(model.follow_ups(spark, sf_dir).withColumnRenamed("source_email_id", "mail_id"), found).select("follow_up_id", "status")


@query("STM8_keyed_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")
def keyed_dedup(spark, sf_dir):
    return model.table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


_CACHED = "SELECT event_type AS kind, user_id AS key, max(event_id) FILTER (nth = 1) AS entry, max(ts) + CASE WHEN event_type = 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 7 DAY END AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) GROUP BY event_type, user_id"


@query("SRC6_cache", f"SELECT kind, key, entry, expires_at > (SELECT max(ts) FROM events) AS hit FROM ({_CACHED})")
def cached(spark, sf_dir):
    """A cache of several kinds, each with its own time to live: the last write of a key wins, a read hits until it expires."""
    e = model.table(spark, sf_dir, "events").select(C("event_type").alias("kind"), C("user_id").alias("key"), "ts", "event_id")
    last = e.groupBy("kind", "key").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    lives = F.when(C("kind") == "error", F.expr("interval 1 hour")).otherwise(F.expr("interval 168 hours"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).select("kind", "key", C("m.event_id").alias("entry"), (C("m.ts") + lives > C("now")).alias("hit"))


@query("STM6_ttl", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)")
def cache(spark, sf_dir):
    """The latest entry of a key, if it has not expired at the time of the newest; an aggregate instead of a window."""
    e = model.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    latest = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.*")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return latest.join(F.broadcast(now), C("ts") + F.expr("interval 7 days") > C("now")).select("user_id", "event_id")


@query("SRC4_entities", with_views("SELECT lower(coalesce(domain, name)) AS key, name AS company FROM (SELECT *, row_number() OVER (PARTITION BY lower(coalesce(domain, name)) ORDER BY company_id) AS nth FROM companies) WHERE nth = 1"))
def entities(spark, sf_dir):
    rows = model.companies(spark, sf_dir).select("company_id", C("name").alias("company"), "domain", "industry", "country", F.lit(None).cast("string").alias("city"), *[F.lit("").alias(c) for c in ("contactName", "title", "email", "linkedin")])
    return csv_leads.entities(rows, "company_id")[0].select("key", "company")


@query("SRC5_csv_lines", with_views("""SELECT list_transform([0], lambda x: name || ',,' || coalesce(CASE WHEN contains(description, ',') THEN '"' || description || '"' ELSE description END, ''))[1] AS line FROM companies"""))
def csv_out(spark, sf_dir):
    rows = model.companies(spark, sf_dir).select("name", F.lit("").alias("website"), F.coalesce("description", F.lit("")).alias("note"))
    return csv_leads.csv_lines(rows)


@query("SNK4_row_defaults", with_views("SELECT contact_id, coalesce(nullif(trim(email), ''), 'none') AS email, coalesce(nullif(trim(title), ''), 'Team Member') AS title, coalesce(channel, 'unknown') AS channel FROM contacts"))
def row_defaults(spark, sf_dir):
    some = lambda c, d: F.coalesce(F.nullif(F.trim(C(c)), F.lit("")), F.lit(d)).alias(c)
    return model.contacts(spark, sf_dir).select("contact_id", some("email", "none"), some("title", "Team Member"), some("channel", "unknown"))


@query("SNK5_enriched_view", with_views("SELECT contact_id, full_name AS name, title AS role FROM contacts WHERE enriched_at IS NOT NULL"))
def enriched_view(spark, sf_dir):
    return model.contacts(spark, sf_dir).where("enriched_at is not null").select("contact_id", C("full_name").alias("name"), C("title").alias("role"))


@query("JN11_mentions", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'mit license|apache license|general public')")
def mentions(spark, sf_dir):
    """Terms in one pattern, so the text is read once and nothing is joined."""
    return model.table(spark, sf_dir, "documents").where(F.lower("text").rlike("mit license|apache license|general public")).select("doc_id")


_projection("LEAD2_detail_type", "contacts", "contact_id", {"kind": (lambda: F.when(F.coalesce(C("email") != "", F.lit(False)), "personal_email").when(F.coalesce(C("linkedin_url") != "", F.lit(False)), "linkedin").otherwise("none"), "CASE WHEN email <> '' THEN 'personal_email' WHEN linkedin_url <> '' THEN 'linkedin' ELSE 'none' END")})
_projection("LEAD3_seed_mapping", "companies", "company_id", {"confidence_of_seed": (lambda: F.least(F.lit(85), F.when(C("company_id") % 2 == 0, 55).otherwise(40) + F.floor((C("confidence") - 50) / 5 + 0.5)), "CAST(least(85, CASE WHEN company_id % 2 = 0 THEN 55 ELSE 40 END + floor((confidence - 50) / 5.0 + 0.5)) AS BIGINT)")})
_projection("LEAD4_views", "contacts", "contact_id", {"person": (lambda: F.to_json(F.struct(C("full_name").alias("name"), C("title").alias("role"))), """'{"name":"' || full_name || '","role":"' || title || '"}'""")})

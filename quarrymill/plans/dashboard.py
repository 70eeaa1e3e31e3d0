"""Queries of the dashboard: aggregates, funnels, summaries."""

from __future__ import annotations

from ..operators import metrics as M
from ..registry import query
from ..sources import model
from ..sources.model import with_views

_HALF = "floor({0} + 0.5)"
_PERCENT = "CASE WHEN {1} > 0 THEN CAST(floor({0} * 100.0::DOUBLE / {1} + 0.5) AS BIGINT) END"
_BASE = """SELECT (SELECT count(*) FROM contacts) AS leads, (SELECT count(enriched_at) FROM contacts) AS enriched,
 (SELECT count(DISTINCT contact_id) FROM emails WHERE status = 'sent') AS contacted, (SELECT count(DISTINCT contact_id) FROM emails WHERE reply_status = 'replied') AS contacts_replied,
 (SELECT count(*) FROM emails WHERE status = 'sent') AS sent, (SELECT count(*) FROM emails WHERE reply_status = 'replied') AS emails_replied"""


@query(
    "AGG1_lead_metrics",
    with_views("""SELECT count(*) AS total, count(enriched_at) AS enriched, count(lead_score) AS scored, count(*) FILTER (email <> '') AS with_email,
 count(*) FILTER (email_status = 'valid') AS verified, count(*) FILTER (lead_score >= 8) AS hot, count(*) FILTER (paused) AS paused, floor(avg(lead_score) * 10 + 0.5) / 10 AS avg_score FROM contacts"""),
)
def lead_metrics(spark, sf_dir):
    return M.lead_metrics(model.contacts(spark, sf_dir))


@query(
    "AGG2_score_histogram",
    with_views("""SELECT band, low, high, count(lead_score) AS n FROM (VALUES ('Low', 1, 3), ('Fair', 4, 5), ('Good', 6, 7), ('Hot', 8, 10)) b(band, low, high)
 LEFT JOIN contacts ON lead_score BETWEEN low AND high GROUP BY ALL"""),
)
def score_histogram(spark, sf_dir):
    return M.score_histogram(model.contacts(spark, sf_dir))


@query(
    "AGG3_top_leads",
    with_views("""SELECT contact_id, full_name, coalesce(name, 'Unknown') AS company, lead_score FROM contacts LEFT JOIN companies USING (company_id)
 WHERE lead_score IS NOT NULL ORDER BY lead_score DESC, contact_id LIMIT 5"""),
)
def top_leads(spark, sf_dir):
    return M.top_leads(model.contacts(spark, sf_dir), model.companies(spark, sf_dir))


_MAIL = """count(*) AS generated, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (reply_status = 'replied') AS replied,
 count(*) FILTER (status = 'sent' AND reply_status = 'none') AS awaiting"""


@query("AGG4_email_metrics", with_views(f"SELECT *, {_PERCENT.format('replied', 'sent')} AS conversion FROM (SELECT {_MAIL} FROM emails)"))
def email_metrics(spark, sf_dir):
    return M.email_metrics(model.emails(spark, sf_dir))


@query(
    "AGG5_tone_breakdown",
    with_views("""SELECT tone, count(*) AS n, list_position(['professional', 'friendly', 'casual', 'persuasive'], tone) AS position
 FROM (SELECT CASE WHEN tone IN ('professional', 'friendly', 'casual', 'persuasive') THEN tone ELSE 'professional' END AS tone FROM emails) GROUP BY tone"""),
)
def tone_breakdown(spark, sf_dir):
    return M.tone_breakdown(model.emails(spark, sf_dir))


@query("AGG6_latest_campaigns", with_views("SELECT CAST(sum(sent_count) AS BIGINT) AS sent, CAST(sum(failed_count) AS BIGINT) AS failed, (SELECT count(*) FROM campaigns) AS campaigns FROM (SELECT * FROM campaigns ORDER BY created_ord DESC, campaign_id LIMIT 5)"))
def latest_campaigns(spark, sf_dir):
    return M.latest_campaign_sums(model.campaigns(spark, sf_dir))


@query(
    "AGG7_recent_replies",
    with_views("""SELECT email_id, coalesce(full_name, 'Unknown') AS lead, strftime(replied_at, '%Y-%m-%d') AS replied_on FROM emails LEFT JOIN contacts USING (contact_id)
 WHERE reply_status = 'replied' AND replied_at IS NOT NULL ORDER BY replied_at DESC, email_id LIMIT 5"""),
)
def recent_replies(spark, sf_dir):
    return M.recent_replies(model.emails(spark, sf_dir), model.contacts(spark, sf_dir))


@query("AGG8_contacted", with_views("SELECT count(DISTINCT CASE WHEN status = 'sent' THEN contact_id END) AS contacted, count(DISTINCT CASE WHEN reply_status = 'replied' THEN contact_id END) AS replied FROM emails"))
def contacted(spark, sf_dir):
    return M.contacted(model.emails(spark, sf_dir))


@query(
    "AGG9_funnel",
    with_views(f"""SELECT position, stage, n, {_PERCENT.format('n', 'previous')} AS from_previous, {_PERCENT.format('n', 'start')} AS from_start FROM (
 SELECT *, lag(n) OVER (ORDER BY position) AS previous, first_value(n) OVER (ORDER BY position) AS start FROM (
 SELECT 1 AS position, 'leads' AS stage, leads AS n FROM ({_BASE}) UNION ALL SELECT 2, 'enriched', enriched FROM ({_BASE})
 UNION ALL SELECT 3, 'contacted', contacted FROM ({_BASE}) UNION ALL SELECT 4, 'replied', contacts_replied FROM ({_BASE})))"""),
)
def funnel(spark, sf_dir):
    return M.funnel(M.conversion_base(model.contacts(spark, sf_dir), model.emails(spark, sf_dir)))


@query(
    "AGG10_rates",
    with_views(f"""SELECT *, {_PERCENT.format('part', 'whole')} AS percent FROM (SELECT 'enrichment' AS rate, enriched AS part, leads AS whole FROM ({_BASE})
 UNION ALL SELECT 'outreach', contacted, enriched FROM ({_BASE}) UNION ALL SELECT 'email reply', emails_replied, sent FROM ({_BASE})
 UNION ALL SELECT 'contact reply', contacts_replied, contacted FROM ({_BASE}) UNION ALL SELECT 'overall', contacts_replied, leads FROM ({_BASE}))"""),
)
def rates(spark, sf_dir):
    return M.rates(M.conversion_base(model.contacts(spark, sf_dir), model.emails(spark, sf_dir)))


_STATS = """SELECT (SELECT count(*) FROM searches) AS searches, (SELECT count(enriched_at) FROM contacts) AS enriched, (SELECT count(*) FROM emails WHERE status = 'sent') AS sent,
 (SELECT count(*) FROM emails WHERE reply_status = 'replied') AS replied, (SELECT count(*) FROM emails WHERE status = 'draft') AS draft, (SELECT count(*) FROM campaigns) AS campaigns"""


def _stats(spark, sf_dir):
    return M.dashboard_stats(*(f(spark, sf_dir) for f in (model.searches, model.contacts, model.emails, model.campaigns)))


@query("AGG11_dashboard_stats", with_views(f"SELECT *, {_PERCENT.format('replied', 'sent')} AS conversion FROM ({_STATS})"))
def dashboard_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query("AGG12_reply_summary", with_views("SELECT count(*) AS sent, count(*) FILTER (reply_status = 'replied') AS replied, count(*) FILTER (reply_status = 'none') AS awaiting FROM emails WHERE status = 'sent'"))
def reply_summary(spark, sf_dir):
    return M.reply_summary(model.emails(spark, sf_dir))


@query(
    "AGG12_follow_up_summary",
    with_views("""SELECT count(*) FILTER (status = 'scheduled') AS scheduled, count(*) FILTER (status = 'cancelled' AND cancel_reason = 'replied') AS cancelled_by_reply,
 count(*) FILTER (status = 'sent') AS sent FROM follow_ups"""),
)
def follow_up_summary(spark, sf_dir):
    return M.follow_up_summary(model.follow_ups(spark, sf_dir))


@query("AGG13_status_counts", with_views("""SELECT count(*) AS "all", count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'completed') AS completed FROM searches"""))
def status_counts(spark, sf_dir):
    return M.status_counts(model.searches(spark, sf_dir))


_LEAD = "enriched_at IS NOT NULL AND (channel = 'email' OR (channel IS NULL AND email <> ''))"
_PROGRESS = f"""SELECT (SELECT count(*) FROM companies) AS companies, count(*) AS contacts, count(enriched_at) AS enriched, count(email_status) AS verified, count(lead_score) AS scored,
 count(*) FILTER ({_LEAD}) AS email_leads FROM contacts WHERE NOT discarded"""


@query("AGG14_progress", with_views(_PROGRESS))
def progress(spark, sf_dir):
    return M.progress(model.companies(spark, sf_dir), model.contacts(spark, sf_dir))


@query(
    "AGG15_step_gates",
    with_views(f"""SELECT true AS step1_enabled, companies > 0 AS step2_enabled, contacts > 0 AS step3_enabled, email_leads > 0 AS step4_enabled, enriched > 0 AND email_leads = 0 AS step4_skipped,
 enriched > 0 AND ((enriched > 0 AND email_leads = 0) OR verified > 0) AS step5_enabled, companies > 0 AS step1_complete, contacts > 0 AS step2_complete, enriched > 0 AS step3_complete,
 verified > 0 AS step4_complete, scored > 0 AS step5_complete FROM ({_PROGRESS})"""),
)
def step_gates(spark, sf_dir):
    return M.step_gates(M.progress(model.companies(spark, sf_dir), model.contacts(spark, sf_dir)))


@query("AGG17_score_summary", with_views("SELECT coalesce(floor(avg(lead_score) * 10 + 0.5) / 10, 0) AS average, count(*) FILTER (confidence >= 40) AS intent_leads FROM contacts"))
def score_summary(spark, sf_dir):
    return M.score_summary(model.contacts(spark, sf_dir))


@query("AGG19_companies_with_contacts", with_views("SELECT count(DISTINCT company_id) AS companies FROM contacts"))
def companies_with_contacts(spark, sf_dir):
    return M.companies_with_contacts(model.contacts(spark, sf_dir))


@query("AGG21_onboarding", with_views(f"SELECT searches > 0 AS has_searches, enriched > 0 AS has_enriched, sent > 0 AS has_sent, replied > 0 AS has_replied FROM ({_STATS})"))
def onboarding(spark, sf_dir):
    return M.onboarding(_stats(spark, sf_dir))


@query(
    "AGG22_chart_totals",
    with_views("""SELECT (SELECT count(*) FROM contacts WHERE lead_score BETWEEN 1 AND 3 OR lead_score BETWEEN 4 AND 5 OR lead_score BETWEEN 6 AND 7 OR lead_score BETWEEN 8 AND 10) AS scored_in_bands,
 (SELECT count(*) FROM emails) AS tones"""),
)
def chart_totals(spark, sf_dir):
    return M.chart_totals(model.contacts(spark, sf_dir), model.emails(spark, sf_dir))

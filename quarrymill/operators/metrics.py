"""Dashboard aggregates: each one conditional pass over its table, with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score bands, inclusive; a score between two bands is in none.
BANDS = [("Low", 1, 3), ("Fair", 4, 5), ("Good", 6, 7), ("Hot", 8, 10)]
TONE_ORDER = ["professional", "friendly", "casual", "persuasive"]


def filled(column: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(column != "", F.lit(False))


def half_up(column: Column) -> Column:
    return F.floor(column + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """round(100 part / whole), half up; null without a positive whole."""
    return F.when(whole > 0, half_up(part * 100.0 / whole))


def lead_metrics(contacts: DataFrame) -> DataFrame:
    score = F.col("lead_score")
    return contacts.agg(
        F.count("*").alias("total"),
        F.count("enriched_at").alias("enriched"),
        F.count("lead_score").alias("scored"),
        F.count_if(filled(F.col("email"))).alias("with_email"),
        F.count_if(F.col("email_status") == "valid").alias("verified"),
        F.count_if(score >= 8).alias("hot"),
        F.count_if("paused").alias("paused"),
        (half_up(F.avg(score) * 10) / 10).alias("avg_score"),
    )


def score_histogram(contacts: DataFrame) -> DataFrame:
    """All bands, empty ones with 0: counts are taken as columns, then turned into rows."""
    counts = contacts.agg(*[F.count_if(F.col("lead_score").between(low, high)).alias(name) for name, low, high in BANDS])
    rows = ", ".join(f"'{name}', {low}, {high}, `{name}`" for name, low, high in BANDS)
    return counts.selectExpr(f"stack({len(BANDS)}, {rows}) as (band, low, high, n)")


def top_leads(contacts: DataFrame, companies: DataFrame, k: int = 5) -> DataFrame:
    """The k best by score, then id: only k rows reach the join."""
    best = contacts.where(F.col("lead_score").isNotNull()).select("contact_id", "company_id", "full_name", "lead_score").orderBy(F.desc("lead_score"), "contact_id").limit(k)
    return best.join(companies.select("company_id", F.col("name").alias("company")), "company_id", "left").select("contact_id", "full_name", F.coalesce("company", F.lit("Unknown")).alias("company"), "lead_score")


def _email_counts() -> list[Column]:
    sent, replied = F.col("status") == "sent", F.col("reply_status") == "replied"
    return [F.count("*").alias("generated"), F.count_if(F.col("status") == "draft").alias("draft"), F.count_if(sent).alias("sent"), F.count_if(replied).alias("replied"), F.count_if(sent & (F.col("reply_status") == "none")).alias("awaiting")]


def email_metrics(emails: DataFrame) -> DataFrame:
    return emails.agg(*_email_counts()).withColumn("conversion", percent(F.col("replied"), F.col("sent")))


def tone_breakdown(emails: DataFrame) -> DataFrame:
    """Unknown tones count as professional; tones without mails are left out."""
    tone = F.when(F.col("tone").isin(TONE_ORDER), F.col("tone")).otherwise("professional")
    position = F.array_position(F.array(*map(F.lit, TONE_ORDER)), F.col("tone"))
    return emails.groupBy(tone.alias("tone")).agg(F.count("*").alias("n")).withColumn("position", position).orderBy("position")


def latest_campaign_sums(campaigns: DataFrame, k: int = 5) -> DataFrame:
    """Sums over the k newest campaigns; the number counts all."""
    newest = campaigns.orderBy(F.desc("created_ord"), "campaign_id").limit(k).agg(F.sum("sent_count").alias("sent"), F.sum("failed_count").alias("failed"))
    return newest.crossJoin(campaigns.agg(F.count("*").alias("campaigns")))  # one row each


def recent_replies(emails: DataFrame, contacts: DataFrame, k: int = 5) -> DataFrame:
    latest = emails.where((F.col("reply_status") == "replied") & F.col("replied_at").isNotNull()).orderBy(F.desc("replied_at"), "email_id").limit(k)
    return latest.join(contacts.select("contact_id", "full_name"), "contact_id", "left").select("email_id", F.coalesce("full_name", F.lit("Unknown")).alias("lead"), F.date_format("replied_at", "yyyy-MM-dd").alias("replied_on"))


def contacted(emails: DataFrame) -> DataFrame:
    """Distinct contacts with a sent mail, and with a reply.

    One row a contact first, so a distinct count needs no expansion of the input; replies count with or without a sent mail.
    """
    each = emails.groupBy("contact_id").agg(F.max(F.col("status") == "sent").alias("sent"), F.max(F.col("reply_status") == "replied").alias("replied"))
    return each.agg(F.count_if("sent").alias("contacted"), F.count_if("replied").alias("replied"))


def conversion_base(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """The one row that funnel and rates are drawn from."""
    leads = contacts.agg(F.count("*").alias("leads"), F.count("enriched_at").alias("enriched"))
    people = contacted(emails).withColumnsRenamed({"contacted": "contacted", "replied": "contacts_replied"})
    mails = emails.agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("reply_status") == "replied").alias("emails_replied"))
    return leads.crossJoin(people).crossJoin(mails)


def funnel(base: DataFrame) -> DataFrame:
    stages = base.selectExpr("stack(4, 1, 'leads', leads, 2, 'enriched', enriched, 3, 'contacted', contacted, 4, 'replied', contacts_replied) as (position, stage, n)")
    ordered = Window.partitionBy(F.lit(1)).orderBy("position")  # four rows
    previous, start = F.lag("n").over(ordered), F.first("n").over(ordered)
    return stages.select("position", "stage", "n", percent(F.col("n"), previous).alias("from_previous"), percent(F.col("n"), start).alias("from_start"))


def rates(base: DataFrame) -> DataFrame:
    pairs = {"enrichment": ("enriched", "leads"), "outreach": ("contacted", "enriched"), "email reply": ("emails_replied", "sent"), "contact reply": ("contacts_replied", "contacted"), "overall": ("contacts_replied", "leads")}
    rows = ", ".join(f"'{k}', {a}, {b}" for k, (a, b) in pairs.items())
    return base.selectExpr(f"stack({len(pairs)}, {rows}) as (rate, part, whole)").withColumn("percent", percent(F.col("part"), F.col("whole")))


def dashboard_stats(searches: DataFrame, contacts: DataFrame, emails: DataFrame, campaigns: DataFrame) -> DataFrame:
    one = [searches.agg(F.count("*").alias("searches")), contacts.agg(F.count("enriched_at").alias("enriched")), emails.agg(*_email_counts()).select("sent", "replied", "draft"), campaigns.agg(F.count("*").alias("campaigns"))]
    out = one[0]
    for part in one[1:]:
        out = out.crossJoin(part)
    return out.withColumn("conversion", percent(F.col("replied"), F.col("sent")))


def reply_summary(emails: DataFrame) -> DataFrame:
    sent = F.col("status") == "sent"
    return emails.agg(F.count_if(sent).alias("sent"), F.count_if(sent & (F.col("reply_status") == "replied")).alias("replied"), F.count_if(sent & (F.col("reply_status") == "none")).alias("awaiting"))


def follow_up_summary(follow_ups: DataFrame) -> DataFrame:
    return follow_ups.agg(F.count_if(F.col("status") == "scheduled").alias("scheduled"), F.count_if((F.col("status") == "cancelled") & (F.col("cancel_reason") == "replied")).alias("cancelled_by_reply"), F.count_if(F.col("status") == "sent").alias("sent"))


def status_counts(searches: DataFrame) -> DataFrame:
    return searches.agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in ("draft", "active", "completed")])


def email_lead() -> Column:
    """Enriched, with mail as the channel, or no channel and an address."""
    return F.col("enriched_at").isNotNull() & F.coalesce((F.col("channel") == "email") | (F.col("channel").isNull() & filled(F.col("email"))), F.lit(False))


def progress(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Discarded contacts are left out."""
    live = contacts.where("not discarded")
    return companies.agg(F.count("*").alias("companies")).crossJoin(live.agg(F.count("*").alias("contacts"), F.count("enriched_at").alias("enriched"), F.count_if(F.col("email_status").isNotNull()).alias("verified"), F.count("lead_score").alias("scored"), F.count_if(email_lead()).alias("email_leads")))


def step_gates(steps: DataFrame) -> DataFrame:
    """Which of the five steps can run, have run, or are passed over for want of mail leads."""
    c = F.col
    skipped = (c("enriched") > 0) & (c("email_leads") == 0)
    return steps.select(
        F.lit(True).alias("step1_enabled"),
        (c("companies") > 0).alias("step2_enabled"),
        (c("contacts") > 0).alias("step3_enabled"),
        (c("email_leads") > 0).alias("step4_enabled"),
        skipped.alias("step4_skipped"),
        ((c("enriched") > 0) & (skipped | (c("verified") > 0))).alias("step5_enabled"),
        (c("companies") > 0).alias("step1_complete"),
        (c("contacts") > 0).alias("step2_complete"),
        (c("enriched") > 0).alias("step3_complete"),
        (c("verified") > 0).alias("step4_complete"),
        (c("scored") > 0).alias("step5_complete"),
    )


def verification_summary(checked: DataFrame) -> DataFrame:
    """checked: status, display."""
    return checked.agg(F.count_if(F.col("display") == "verified").alias("valid"), F.count_if(F.col("status").isin("invalid", "invalid_syntax", "invalid_domain")).alias("invalid"), F.count_if(F.col("display").isin("likely_valid", "risky")).alias("risky"), F.count_if(F.col("status") == "no_email").alias("skipped"))


def score_summary(contacts: DataFrame) -> DataFrame:
    return contacts.agg((F.coalesce(half_up(F.avg("lead_score") * 10) / 10, F.lit(0.0))).alias("average"), F.count_if(F.col("confidence") >= 40).alias("intent_leads"))


def companies_with_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.select("company_id").where("company_id is not null").distinct().agg(F.count("*").alias("companies"))


def onboarding(stats: DataFrame) -> DataFrame:
    return stats.select(*[(F.col(c) > 0).alias(f"has_{c}") for c in ("searches", "enriched", "sent", "replied")])


def chart_totals(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    return score_histogram(contacts).agg(F.sum("n").alias("scored_in_bands")).crossJoin(tone_breakdown(emails).agg(F.sum("n").alias("tones")))

"""Rules of mailboxes and tiers over the contacts' own columns, held against SQL that says them in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, fixed
from ..registry import query
from ..sources import csv_leads, model
from ..sources.model import with_views

C = F.col
#: The contact's address, or another in its place by key: a shared one, with marks and digits, the initial and the last name, a
#: stranger's, an example's, one without an @.
_MAIL_SQL = """CASE contact_id % 9 WHEN 1 THEN 'info@mail' || company_id || '.example' WHEN 2 THEN ' Support-7@Mail.example ' WHEN 3 THEN 'flast@mail.example' WHEN 4 THEN 'stranger@mail.example'
 WHEN 5 THEN 'user@example.com' WHEN 6 THEN 'no address' WHEN 7 THEN 'Last' || contact_id % 89 || '@mail.example' ELSE email END"""
_SHARED = ", ".join(f"'{x}'" for x in contacts.SHARED_MAILBOXES)
_BARE = "regexp_replace(split_part(low, '@', 1), '[._-]', '', 'g')"
_OWN = "regexp_replace(split_part(low, '@', 1), '[._+-]', '', 'g')"
_RULES = f"""SELECT *, coalesce({_BARE} = '' OR {_BARE} IN ({_SHARED}) OR regexp_replace({_BARE}, '[0-9]', '', 'g') IN ({_SHARED}), true) AS shared,
  coalesce(length({_OWN}) >= 2 AND ({_OWN} IN ('first', 'last', 'firstlast', 'flast', 'fl') OR (contains({_OWN}, 'first') AND contains({_OWN}, 'last'))), false) AS own,
  coalesce(NOT contains(trim(low), '@') OR regexp_matches(trim(low), '{"|".join(fixed.PLACEHOLDER_EMAILS)}'), true) AS placeholder
 FROM (SELECT contact_id, mail, lower(mail) AS low, linkedin_url FROM (SELECT contact_id, company_id, linkedin_url, {_MAIL_SQL} AS mail FROM contacts))"""


def _mailboxes(spark, sf_dir):
    key = C("contact_id")
    case = key % 9
    mail = (
        F.when(case == 1, F.concat(F.lit("info@mail"), "company_id", F.lit(".example")))
        .when(case == 2, " Support-7@Mail.example ")
        .when(case == 3, "flast@mail.example")
        .when(case == 4, "stranger@mail.example")
        .when(case == 5, "user@example.com")
        .when(case == 6, "no address")
        .when(case == 7, F.concat(F.lit("Last"), key % 89, F.lit("@mail.example")))
        .otherwise(C("email"))
    )
    return model.contacts(spark, sf_dir).select("contact_id", "full_name", "linkedin_url", mail.alias("mail"))


@query("FLT20_mailboxes_of_contacts", with_views(f"SELECT contact_id, shared, own FROM ({_RULES})"))
def mailboxes(spark, sf_dir):
    """Whether an address is nobody's in particular, and whether it carries its contact's name."""
    return _mailboxes(spark, sf_dir).select("contact_id", contacts.is_shared(C("mail")).alias("shared"), contacts.is_own(C("mail"), C("full_name")).alias("own"))


@query(
    "CLS6_tiers_of_contacts",
    with_views(f"""SELECT contact_id, CASE WHEN coalesce(trim(low), '') <> '' THEN CASE WHEN placeholder THEN CASE WHEN coalesce(linkedin_url, '') <> '' THEN 'medium' ELSE 'low' END WHEN NOT shared AND own THEN 'high' ELSE 'low' END
 WHEN coalesce(linkedin_url, '') <> '' THEN 'medium' ELSE 'low' END AS tier FROM ({_RULES.replace("lower(mail) AS low", "trim(lower(mail)) AS low")})"""),
)
def tiers(spark, sf_dir):
    """high: the contact's own address, medium: a profile alone, low: the rest."""
    return _mailboxes(spark, sf_dir).select("contact_id", contacts.quality_tier(C("mail"), C("full_name"), C("linkedin_url")).alias("tier"))


@query("STR12_addresses_of_contacts", with_views(f"SELECT contact_id, CASE WHEN low <> '' AND NOT placeholder AND NOT shared AND own THEN low END AS personal, CASE WHEN low <> '' AND NOT placeholder THEN low END AS public FROM ({_RULES.replace('lower(mail) AS low', 'trim(lower(mail)) AS low')})"))
def addresses(spark, sf_dir):
    """The address as a person's own, and as one that may be shown."""
    return _mailboxes(spark, sf_dir).select("contact_id", contacts.personal_email(C("mail"), C("full_name")).alias("personal"), contacts.public_email(C("mail")).alias("public"))


_LABELS = {"valid": "Verified", "invalid": "Invalid", "catch_all": "Risky", "unknown": "Likely valid"}
_CELLS = ["k.name", "''", "''", "k.country", "''", "''", "c.full_name", "c.title", "c.email", "CASE c.email_status " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _LABELS.items()) + " END", "CASE WHEN c.email <> '' THEN 'email, direct' WHEN c.linkedin_url <> '' THEN 'profile \"only\"' END", "c.linkedin_url", "CAST(c.confidence * 3 AS VARCHAR)", "''", "''", "CAST(k.confidence AS VARCHAR)", "k.website_url"]


def _csv_sql(cell: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({cell}, ''), '[\",\\n\\r]') THEN '\"' || replace(coalesce({cell}, ''), '\"', '\"\"') || '\"' ELSE coalesce({cell}, '') END"


@query("SRC5_export_of_leads", with_views(f"SELECT c.contact_id, concat_ws(',', {', '.join(_csv_sql(x) for x in _CELLS)}) AS line FROM contacts c JOIN companies k ON c.company_id = k.company_id WHERE c.enriched_at IS NOT NULL"))
def export_of_leads(spark, sf_dir):
    """Enriched contacts as lines of the export, all seventeen columns in their order."""
    people = model.contacts(spark, sf_dir).where("enriched_at is not null")
    firms = model.companies(spark, sf_dir).select("company_id", C("name").alias("company"), "country", C("confidence").alias("confidenceScore"), C("website_url").alias("sourceUrl"))
    label = F.coalesce(*[F.when(C("email_status") == a, b) for a, b in _LABELS.items()])
    kind = F.when(C("email") != "", "email, direct").when(C("linkedin_url") != "", 'profile "only"')
    rows = people.select("contact_id", "company_id", C("full_name").alias("contactName"), "title", "email", label.alias("emailStatus"), kind.alias("contactType"), C("linkedin_url").alias("linkedin"), (C("confidence") * 3).alias("leadScore")).join(firms, "company_id")
    cells = csv_leads.export(rows.withColumn("website", F.lit("")), "contact_id")
    return csv_leads.csv_lines(cells, "contact_id")

"""Queries over known brands, completeness, confidence, quality and soft relevance of one fixed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..functions import relevance as R
from ..operators.metrics import filled, half_up
from ..registry import query
from ..sources import model
from ..sources.model import with_views
from .functions import _REL, _TEXT, C, _has, _match_sql, _projection
from .relevance import _BLOCK, _INVESTOR, _MEDIA

# fixed values: brands whose pages say little: industry, and words added to the description
BRANDS = {
    "alibaba.com": ("E-commerce", "Global online marketplace and e-commerce platform"),
    "aliexpress.com": ("E-commerce", "Online retail marketplace"),
    "amazon.com": ("E-commerce", "E-commerce and online marketplace"),
    "ebay.com": ("E-commerce", "Online marketplace"),
    "etsy.com": ("E-commerce", "E-commerce marketplace for handmade goods"),
    "shopify.com": ("E-commerce", "E-commerce platform for online stores"),
    "zalando.com": ("E-commerce", "European online fashion retailer"),
    "hm.com": ("E-commerce", "Fashion retailer with online store"),
    "ikea.com": ("E-commerce", "Furniture retailer with e-commerce"),
    "aldi.com": ("E-commerce", "Grocery retailer with online shopping"),
}
_SITE = "CASE company_id % 4 WHEN 0 THEN 'www.etsy.com' WHEN 1 THEN 'ikea.com' ELSE domain END"


@query("CLS4_known_brands", with_views(f"""SELECT company_id, coalesce(industry, brand_industry) AS industry, CASE WHEN brand_hint IS NULL THEN description ELSE trim(concat_ws(' ', nullif(description, ''), brand_hint)) END AS description
 FROM (SELECT *, {_SITE} AS site FROM companies) LEFT JOIN (VALUES {", ".join(f"('{d}', '{i}', '{h}')" for d, (i, h) in BRANDS.items())}) b(brand, brand_industry, brand_hint) ON regexp_replace(lower(site), '^www\\.', '') = brand"""))
def known_brands(spark, sf_dir):
    """Ten brands are a literal map, so nothing is joined."""
    lookup = F.create_map(*[x for d, (i, h) in BRANDS.items() for x in (F.lit(d), F.struct(F.lit(i).alias("industry"), F.lit(h).alias("hint")))])
    site = F.when(C("company_id") % 4 == 0, "www.etsy.com").when(C("company_id") % 4 == 1, "ikea.com").otherwise(C("domain"))
    brand = F.when(site.isNotNull(), F.try_element_at(lookup, F.regexp_replace(F.lower(site), r"^www\.", "")))
    rows = model.companies(spark, sf_dir).withColumn("b", brand)
    said = F.trim(F.concat_ws(" ", F.nullif(C("description"), F.lit("")), C("b.hint")))
    return rows.select("company_id", F.coalesce("industry", "b.industry").alias("industry"), F.when(C("b").isNull(), C("description")).otherwise(said).alias("description"))


def _sum(start: int, most: int, points: list):
    total = F.lit(start)
    for test, value in points:
        total = total + F.when(F.coalesce(test, F.lit(False)), value).otherwise(0)
    return F.least(total, F.lit(most))


_projection(
    "SCO12_completeness",
    "companies",
    "company_id",
    {
        "listing": (lambda: _sum(10, 100, [(F.length(F.trim("name")) >= 2, 10), (filled(C("website_url")), 20), (filled(C("country")), 15), (F.length("description") > 40, 20), (filled(C("description")) & (F.length("description") <= 40), 8), (filled(C("linkedin_url")), 5)]), "10 + 10 + CASE WHEN website_url <> '' THEN 20 ELSE 0 END + CASE WHEN country <> '' THEN 15 ELSE 0 END + CASE WHEN length(description) > 40 THEN 20 WHEN description <> '' THEN 8 ELSE 0 END + CASE WHEN linkedin_url <> '' THEN 5 ELSE 0 END"),
        "place": (lambda: _sum(45, 95, [(F.trim("website_url") != "", 25), (F.trim("country") != "", 5), (F.size("technologies") > 0, 5)]), "least(95, 45 + CASE WHEN trim(website_url) <> '' THEN 25 ELSE 0 END + CASE WHEN trim(country) <> '' THEN 5 ELSE 0 END + CASE WHEN len(technologies) > 0 THEN 5 ELSE 0 END)"),
        "public": (lambda: _sum(15, 100, [(F.length(F.trim("name")) >= 2, 10), (filled(C("website_url")), 30), (filled(C("country")), 15), (F.length("description") > 40, 20), (filled(C("linkedin_url")), 10)]), "least(100, 25 + CASE WHEN website_url <> '' THEN 30 ELSE 0 END + CASE WHEN country <> '' THEN 15 ELSE 0 END + CASE WHEN length(description) > 40 THEN 20 ELSE 0 END + CASE WHEN linkedin_url <> '' THEN 10 ELSE 0 END)"),
    },
)
_projection("STR26_tags", "companies", "company_id", {"tags": (lambda: F.array_join(F.filter(F.transform(F.split(F.concat(C("name"), F.lit(" , ,"), C("country")), ","), lambda t: F.trim(t)), lambda t: t != ""), "|"), "array_to_string(list_filter(list_transform(string_split(name || ' , ,' || country, ','), lambda t: trim(t)), lambda t: t <> ''), '|')")})

_SHOWN = "CASE email_status WHEN 'valid' THEN 'verified' WHEN 'catch_all' THEN 'likely_valid' WHEN 'invalid' THEN 'invalid' END"
_INTENT = "least(100, " + " + ".join(f"CASE WHEN {_has('description', p)} THEN {fixed.INTENT_POINTS[s]} ELSE 0 END" for _, s, p in fixed.INTENT_RULES) + ")"
_PEOPLE = f"""SELECT contact_id, {_REL} AS rel, coalesce(email <> '', false) AS mail, coalesce(linkedin_url <> '', false) AS profile, {_SHOWN} AS shown, {_has('title', 'ceo|chief executive|founder')} AS wanted,
 m.score AS industry, m.conflict, employee_count, country, {_INTENT} AS intent FROM contacts JOIN companies co USING (company_id) JOIN ({_match_sql('technology')}) m USING (company_id)"""
_PEOPLE = _PEOPLE.replace("linkedin_url <> ''", "contacts.linkedin_url <> ''")


def people(spark, sf_dir):
    """Contacts with what their company is worth; the patterns run once a company."""
    firms = rules.with_industry_match(model.companies(spark, sf_dir), "technology").select("company_id", C("m.score").alias("industry"), C("m.conflict").alias("conflict"), "employee_count", "country", F.coalesce(rules.intent_score(C("description")), F.lit(0)).alias("intent"))
    shown = F.when(C("email_status") == "valid", "verified").when(C("email_status") == "catch_all", "likely_valid").when(C("email_status") == "invalid", "invalid")
    each = model.contacts(spark, sf_dir).select("contact_id", "company_id", rules.title_relevance(C("title")).alias("rel"), filled(C("email")).alias("mail"), filled(C("linkedin_url")).alias("profile"), shown.alias("shown"), text.has(C("title"), "ceo|chief executive|founder").alias("wanted"))
    return each.join(firms, "company_id")


@query(
    "SCO8_lead_confidence",
    with_views(f"""SELECT contact_id, CAST(greatest(0, least(100, floor(rel * 0.35::DOUBLE + 0.5) + CASE WHEN mail THEN 28 ELSE 0 END + CASE WHEN profile THEN 12 ELSE 0 END
 + CASE WHEN industry >= 0.5 THEN floor(industry * 15 + 0.5) WHEN conflict THEN -20 ELSE 0 END + CASE shown WHEN 'verified' THEN 15 WHEN 'likely_valid' THEN 8 WHEN 'invalid' THEN -10 ELSE 0 END
 + CASE WHEN intent >= 70 THEN 12 WHEN intent >= 40 THEN 6 ELSE 0 END)) AS BIGINT) AS confidence FROM ({_PEOPLE})"""),
)
def lead_confidence(spark, sf_dir):
    total = (
        half_up(C("rel") * 0.35)
        + F.when(C("mail"), 28).otherwise(0)
        + F.when(C("profile"), 12).otherwise(0)
        + F.when(C("industry") >= 0.5, half_up(C("industry") * 15)).when(C("conflict"), -20).otherwise(0)
        + F.when(C("shown") == "verified", 15).when(C("shown") == "likely_valid", 8).when(C("shown") == "invalid", -10).otherwise(0)
        + F.when(C("intent") >= 70, 12).when(C("intent") >= 40, 6).otherwise(0)
    )
    return people(spark, sf_dir).select("contact_id", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long").alias("confidence"))


_PARTS = f"""SELECT contact_id, CAST(floor((industry * 0.5::DOUBLE + CASE WHEN country = 'NATION_3' THEN 1 ELSE 0 END * 0.3::DOUBLE + CASE WHEN employee_count IS NULL THEN 0.4::DOUBLE WHEN employee_count BETWEEN 50 AND 500 THEN 1 ELSE 0 END * 0.2::DOUBLE) * 100 + 0.5) AS BIGINT) AS company,
 CAST(floor(rel * 0.7::DOUBLE * CASE WHEN wanted THEN 1 ELSE 0.2::DOUBLE END + CASE WHEN wanted THEN 30 ELSE 0 END + 0.5) AS BIGINT) AS person,
 CAST(least(100, CASE WHEN shown = 'verified' THEN 55 WHEN shown = 'likely_valid' THEN 40 WHEN mail THEN 8 ELSE 0 END + CASE WHEN profile THEN CASE WHEN NOT mail THEN 28 ELSE 18 END ELSE 0 END) AS BIGINT) AS contact,
 CASE WHEN intent >= 70 THEN 8 WHEN intent >= 40 THEN 4 ELSE 0 END AS boost FROM ({_PEOPLE})"""


@query(
    "SCO9_quality",
    with_views(f"""SELECT contact_id, company, person, contact, overall, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 50 THEN 'average' ELSE 'reject' END AS category
 FROM (SELECT *, CAST(least(100, floor(company * 0.35::DOUBLE + person * 0.3::DOUBLE + contact * 0.35::DOUBLE + boost + 0.5)) AS BIGINT) AS overall FROM ({_PARTS}))"""),
)
def quality(spark, sf_dir):
    """Company, person and contact each from 0 to 100, then their weighted sum and its band."""
    size = F.when(C("employee_count").isNull(), 0.4).when(rules.size_matches(C("employee_count"), 50, 500), 1.0).otherwise(0.0)
    company = half_up((C("industry") * 0.5 + F.when(C("country") == "NATION_3", 1).otherwise(0) * 0.3 + size * 0.2) * 100)
    person = half_up(C("rel") * 0.7 * F.when(C("wanted"), 1.0).otherwise(0.2) + F.when(C("wanted"), 30).otherwise(0))
    contact = F.least(F.lit(100), F.when(C("shown") == "verified", 55).when(C("shown") == "likely_valid", 40).when(C("mail"), 8).otherwise(0) + F.when(C("profile"), F.when(~C("mail"), 28).otherwise(18)).otherwise(0))
    boost = F.when(C("intent") >= 70, 8).when(C("intent") >= 40, 4).otherwise(0)
    parts = people(spark, sf_dir).select("contact_id", company.alias("company"), person.alias("person"), contact.cast("long").alias("contact"), boost.alias("boost"))
    overall = F.least(F.lit(100), half_up(C("company") * 0.35 + C("person") * 0.3 + C("contact") * 0.35 + C("boost"))).cast("long")
    return parts.withColumn("overall", overall).select("contact_id", "company", "person", "contact", "overall", rules.quality_category(C("overall")).alias("category"))


_STRONG = f"({_has(_TEXT, R.STRONG_TECH)} OR {_has('industry', r'\btechnology\b|\bsoftware\b|\bsaas\b')})"


@query(
    "FLT6_soft_relevance",
    with_views(f"""SELECT company_id, CASE WHEN {_has(_TEXT, R.HISTORICAL)} THEN 'historical_or_person' WHEN {_MEDIA} THEN 'media_publishing' WHEN m.conflict THEN 'conflicting_industry'
 WHEN {_BLOCK} IS NOT NULL THEN 'non_commercial_org' WHEN {_INVESTOR} THEN 'investor_accelerator' WHEN NOT contains({_TEXT}, 'platform') THEN 'keyword_mismatch'
 WHEN {_has(_TEXT, R.CONGLOMERATE)} THEN 'enterprise_conglomerate' WHEN NOT {_STRONG} THEN 'weak_tech_signal' END AS reason FROM companies JOIN ({_match_sql('technology')}) m USING (company_id)"""),
)
def soft_relevance(spark, sf_dir):
    """Hard reasons first, then the keyword, then what a search for technology firms adds."""
    rows = rules.with_industry_match(model.companies(spark, sf_dir), "technology").withColumn("_text", rules.company_text())
    t = C("_text")
    reason = (
        F.when(R.has(t, R.HISTORICAL), "historical_or_person")
        .when(R.is_media(t, C("domain")), "media_publishing")
        .when(C("m.conflict"), "conflicting_industry")
        .when(R.organisation_block(t, C("domain")).isNotNull(), "non_commercial_org")
        .when(R.is_investor(t, C("name"), C("domain")), "investor_accelerator")
        .when(~t.contains("platform"), "keyword_mismatch")
        .when(R.has(t, R.CONGLOMERATE), "enterprise_conglomerate")
        .when(~R.strong_signal(t, C("industry"), False), "weak_tech_signal")
    )
    return rows.select("company_id", reason.alias("reason"))

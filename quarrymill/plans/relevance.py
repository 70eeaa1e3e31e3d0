"""Queries over relevance, organisations, names, countries in text, pain points and mock verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import rules, text
from ..registry import query
from ..sources import model
from ..sources.model import with_views
from .functions import _TEXT, C, _has, _match_sql, _projection

_HOST = "regexp_replace(lower(domain), '^www\\.', '')"
_MEDIA = f"(coalesce({_HOST} IN ({', '.join(f'{chr(39)}{d}{chr(39)}' for d in R.MEDIA_DOMAINS)}), false) OR {_has(_TEXT, R.MEDIA)})"
_BLOCK = f"CASE WHEN {_has(_HOST, R.PUBLIC_TLD)} THEN 'non_commercial_domain' {' '.join(f'WHEN {_has(_TEXT, p)} THEN {chr(39)}{r}{chr(39)}' for r, p in R.ORGANISATIONS)} WHEN {_has(_TEXT, R.PORTAL)} AND NOT {_has(_TEXT, r'\b(software|saas|technology)\b')} THEN 'information_portal' END"
_INVESTOR = f"((coalesce({_HOST} IN ({', '.join(f'{chr(39)}{d}{chr(39)}' for d in R.INVESTOR_DOMAINS)}), false) OR {_has(_TEXT, R.INVESTOR)}) AND NOT {_has(_TEXT, R.OPERATING)})"


def _text():
    return rules.company_text()


_projection("FLT13_organisations", "companies", "company_id", {"block": (lambda: R.organisation_block(_text(), C("domain")), _BLOCK), "investor": (lambda: R.is_investor(_text(), C("name"), C("domain")), _INVESTOR)})
_projection(
    "FLT8_predicates",
    "companies",
    "company_id",
    {
        "historical": (lambda: R.has(_text(), R.HISTORICAL), _has(_TEXT, R.HISTORICAL)),
        "media": (lambda: R.is_media(_text(), C("domain")), _MEDIA),
        "conglomerate": (lambda: R.has(_text(), R.CONGLOMERATE), _has(_TEXT, R.CONGLOMERATE)),
        "no_saas": (lambda: R.has(_text(), R.NO_SAAS), _has(_TEXT, R.NO_SAAS)),
        "strong_saas": (lambda: R.strong_signal(_text(), C("industry"), True), f"({_has(_TEXT, R.STRONG_SAAS)} OR {_has('industry', r'\bsaas\b|\bsoftware\b')})"),
        "strong_tech": (lambda: R.strong_signal(_text(), C("industry"), False), f"({_has(_TEXT, R.STRONG_TECH)} OR {_has('industry', r'\btechnology\b|\bsoftware\b|\bsaas\b')})"),
    },
)


@query(
    "FLT5_hard_blockers",
    with_views(f"""SELECT company_id, CASE WHEN {_has(_TEXT, R.HISTORICAL)} THEN 'historical_or_person' WHEN {_MEDIA} THEN 'media_publishing' WHEN m.conflict THEN 'conflicting_industry'
 WHEN {_has(_TEXT, R.NO_SAAS)} THEN 'non_saas_tech' WHEN {_BLOCK} IS NOT NULL THEN 'non_commercial_org' WHEN {_INVESTOR} THEN 'investor_accelerator' END AS reason
 FROM companies JOIN ({_match_sql('technology')}) m USING (company_id)"""),
)
def hard_blockers(spark, sf_dir):
    """The first reason against a company, for a search that wants software firms; the text is made once a row."""
    rows = rules.with_industry_match(model.companies(spark, sf_dir), "technology").withColumn("_text", _text())
    reason = (
        F.when(R.has(C("_text"), R.HISTORICAL), "historical_or_person")
        .when(R.is_media(C("_text"), C("domain")), "media_publishing")
        .when(C("m.conflict"), "conflicting_industry")
        .when(R.has(C("_text"), R.NO_SAAS), "non_saas_tech")
        .when(R.organisation_block(C("_text"), C("domain")).isNotNull(), "non_commercial_org")
        .when(R.is_investor(C("_text"), C("name"), C("domain")), "investor_accelerator")
    )
    return rows.select("company_id", reason.alias("reason"))


_projection("FLT7_keywords", "companies", "company_id", {"software": (lambda: _text().rlike("software|saas|application|platform|it services|technology"), f"regexp_matches({_TEXT}, 'software|saas|application|platform|it services|technology')")})
_projection("FLT19_names", "contacts", "contact_id", {"plausible": (lambda: R.plausible_name(F.regexp_replace("full_name", r"\d+", "x")), "true"), "title_as_name": (lambda: R.plausible_name(F.lit("Our Mission")), "false")})
_projection("STR21_country_in_text", "companies", "company_id", {"country_said": (lambda: R.country_in(C("description")), "CASE WHEN contains(lower(description), 'germany') THEN 'Germany' END")})
_projection(
    "STR24_pain_points",
    "companies",
    "company_id",
    {
        "points": (
            lambda: F.array_join(R.pain_points(C("industry"), F.lit("CTO"), C("technologies"), C("employee_count")), ";"),
            """array_to_string(list_concat(CASE WHEN coalesce(industry, '') = '' THEN [] ELSE ['keeping pace with digital transformation in ' || industry, 'delivering reliable software without slowing down the business'] END,
 ['reducing technical debt while maintaining delivery velocity'], CASE WHEN list_contains(technologies, 'React') THEN ['modernizing the frontend experience'] ELSE [] END,
 CASE WHEN employee_count < 50 THEN ['doing more with a lean engineering team'] WHEN employee_count > 500 THEN ['aligning multiple teams around a consistent product vision'] ELSE [] END)[1:4], ';')""",
        )
    },
)
_projection("SCO5_founded", "companies", "company_id", {"year": (lambda: R.founded(C("description")), "TRY_CAST(nullif(regexp_extract(description, '(?i)\\b(?:founded|established|since)\\s*(?:in\\s*)?((?:19|20)\\d{2})\\b', 1), '') AS INTEGER)"), "passed": (lambda: (F.length("name") >= 2) & F.coalesce(C("website_url").startswith("http") | text.likely_company_domain(C("domain")), F.lit(False)) & F.coalesce(F.trim("industry") != "", F.lit(False)) & F.coalesce(F.trim("country") != "", F.lit(False)), "length(name) >= 2 AND coalesce(starts_with(website_url, 'http'), false) AND coalesce(trim(industry) <> '', false) AND coalesce(trim(country) <> '', false)")})
_projection("HTM2_phones", "documents", "doc_id", {"phones": (lambda: F.size(text.phones_in(C("text"))), "CAST(len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '(?:\\+?\\d{1,3}[\\s.-]?)?(?:\\(?\\d{2,4}\\)?[\\s.-]?)?\\d{3,4}[\\s.-]?\\d{3,4}'), lambda p: trim(p))), lambda p: length(regexp_replace(p, '\\D', '', 'g')) >= 8)) AS INTEGER)")})
_projection("HTM12_json_mail", "contacts", "contact_id", {"subject": (lambda: R.mail_of_json(F.concat(F.lit('```json\n{"subject": " Hi '), C("full_name"), F.lit('", "body": "b"}\n```')))["subject"], "'Hi ' || full_name")})

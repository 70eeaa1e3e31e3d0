"""Queries over scalar functions, classifiers and scores; each is one projection of a table, without a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..registry import query
from ..sources import model
from ..sources.model import with_views

def C(name):  # noqa: N802
    return F.col(name)



def _has(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i'), false)"


def _chain(column: str, cases: list, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_has(column, p)} THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for p, v in cases) + f" ELSE {default} END"


def _projection(name: str, source: str, key: str, columns: dict, where: tuple | None = None):
    """columns: alias -> (what gives the Column, SQL); source: a table of the model or of the driver."""
    names = list(columns)
    sql = f"SELECT {key}, " + ", ".join(f"{columns[n][1]} AS {n}" for n in names) + f" FROM {source}" + (f" WHERE {where[1]}" if where else "")

    def run(spark, sf_dir):
        rows = getattr(model, source)(spark, sf_dir) if source in model.VIEWS else model.table(spark, sf_dir, source)
        return (rows.where(where[0]()) if where else rows).select(key, *[columns[n][0]().alias(n) for n in names])

    run.__name__ = name
    query(name, with_views(sql))(run)


_NORM = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '^www\\.', ''), '/.*$', '')"
_projection("STR1_normalize_domain", "companies", "company_id", {"host": (lambda: text.normalize_domain(C("website_url")), _NORM.format("website_url"))})
_projection("STR2_valid_domain", "companies", "company_id", {"valid": (lambda: text.is_domain(C("domain")), _has("domain", fixed.DOMAIN_SYNTAX)), "name_valid": (lambda: text.is_domain(C("name")), _has("name", fixed.DOMAIN_SYNTAX))})
_HOST = "regexp_replace(regexp_extract(lower({0}), '^(?:https?://)?([^/:?#\\s]+)', 1), '^www\\.', '')"
_BLOCKED = "(" + ", ".join(f"'{h}'" for h in fixed.BLOCKED_HOSTS) + ")"
_projection("STR3_domain_of_url", "companies", "company_id", {c: (lambda c=c: text.domain_of_url(C(c)), f"CASE WHEN {_HOST.format(c)} <> '' AND {_HOST.format(c)} NOT IN {_BLOCKED} THEN {_HOST.format(c)} END") for c in ("website_url", "linkedin_url")})
_projection("STR3_page_hosts", "pages", "page_id", {"host": (lambda: text.domain_of_url(C("url")), f"CASE WHEN {_HOST.format('url')} <> '' AND {_HOST.format('url')} NOT IN {_BLOCKED} THEN {_HOST.format('url')} END")})
_projection(
    "STR4_company_site",
    "companies",
    "company_id",
    {
        "likely": (lambda: text.likely_company_domain(C("domain")), f"coalesce(length(domain) >= 4 AND domain NOT IN {_BLOCKED} AND NOT regexp_matches(domain, '\\.(gov|mil|edu|ac)(\\.[a-z]{{2}})?$'), false)"),
        "site": (lambda: text.website_url(C("domain")), "'https://' || regexp_replace(domain, '^www\\.', '')"),
    },
)
_projection("STR5_company_key", "companies", "company_id", {"key": (lambda: text.company_key(C("domain"), C("name"), C("country")), f"coalesce(nullif({_NORM.format('domain')}, ''), 'name:' || lower(trim(name)) || '|country:' || coalesce(lower(trim(country)), ''))")})
_projection("STR6_contact_key", "contacts", "contact_id", {"key": (lambda: text.contact_key(C("email"), C("linkedin_url"), C("company_id"), C("full_name")), "coalesce(nullif(lower(trim(email)), ''), nullif(lower(trim(linkedin_url)), ''), 'company:' || company_id || '|name:' || lower(trim(full_name)))")})
_projection("STR7_collapse", "searches", "search_id", {"clean": (lambda: text.collapse(F.concat(F.lit("  "), C("country"), F.lit("   X "))), "trim(regexp_replace(lower('  ' || country || '   X '), '\\s+', ' ', 'g'))")})
_projection("STR8_split_name", "contacts", "contact_id", {"first": (lambda: text.first_name(C("full_name")), "string_split(full_name, ' ')[1]"), "last": (lambda: text.last_name(C("full_name")), "nullif(array_to_string(string_split(full_name, ' ')[2:], ' '), '')")})
_projection("STR9_person_name", "contacts", "contact_id", {"clean": (lambda: text.person_name(C("full_name")), "trim(regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))")})
_OK = f"coalesce(email <> '' AND length(email) <= 254 AND regexp_matches(lower(trim(email)), '{fixed.EMAIL_SYNTAX.replace(chr(39), chr(39) * 2)}'), false)"
_projection(
    "STR10_email_syntax",
    "contacts",
    "contact_id",
    {
        "valid": (lambda: text.email_ok(C("email")), _OK),
        "host": (lambda: text.email_domain(C("email")), "nullif(regexp_extract(lower(email), '^.+@([^@]+)$', 1), '')"),
        "problem": (lambda: text.email_problem(C("email")), f"CASE WHEN coalesce(email, '') = '' THEN 'Email is empty.' WHEN length(email) > 254 THEN 'Email exceeds maximum length.' WHEN NOT {_OK} THEN 'Email format is invalid.' END"),
    },
)
_A, _B = "'first'", "'last'"
_projection("STR11_email_guesses", "contacts", "contact_id", {"guesses": (lambda: F.array_join(text.email_guesses(C("full_name"), F.lit("abc.example")), " "), "'first@abc.example first.last@abc.example f.last@abc.example firstlast@abc.example'")})
_projection("STR12_placeholder", "contacts", "contact_id", {"placeholder": (lambda: text.is_placeholder(C("email")), f"coalesce(NOT contains(lower(trim(email)), '@') OR {_has('lower(trim(email))', '(' + '|'.join(fixed.PLACEHOLDER_EMAILS) + ')')}, true)")})
_projection("STR13_profile_url", "contacts", "contact_id", {"profile": (lambda: text.profile_url(C("linkedin_url")), "'https://www.linkedin.com/in/' || nullif(regexp_extract(lower(linkedin_url), 'linkedin\\.com/in/([a-z0-9-]+)', 1), '')")})
_projection("STR14_slugs", "companies", "company_id", {"slug": (lambda: text.company_slug(C("linkedin_url")), "nullif(regexp_extract(lower(linkedin_url), 'linkedin\\.com/company/([a-z0-9-]+)', 1), '')")})
_projection("STR18_department", "contacts", "contact_id", {"department": (lambda: rules.department(C("title")), _chain("title", fixed.DEPARTMENTS))})
_projection("STR19_location_and_band", "companies", "company_id", {"place": (lambda: text.location(C("name"), F.lit(" "), C("country")), "nullif(concat_ws(', ', nullif(trim(name), ''), nullif(trim(country), '')), '')"), "band": (lambda: text.employee_band(C("employee_count")), "CASE " + " ".join(f"WHEN employee_count <= {n} THEN '{label}'" for n, label in fixed.EMPLOYEE_BANDS) + " WHEN employee_count IS NOT NULL THEN '5,000+' END")})
_N = "(\\d{1,3}(?:,\\d{3})*)"
_num = lambda pattern, group: f"TRY_CAST(replace(nullif(regexp_extract(description, '(?i){pattern}', {group}), ''), ',', '') AS INTEGER)"
_LOW, _HIGH = (_num(f"{_N}\\s*[-–]\\s*{_N}\\s*employees", g) for g in (1, 2))
_ONE, _STAFF = _num(f"{_N}\\+?\\s*employees?\\b", 1), _num(f"{_N}\\+?\\s*(staff|people|team members)\\b", 1)
_projection("STR20_employee_count", "companies", "company_id", {"employees": (lambda: text.employee_count(C("description")), f"coalesce(CASE WHEN {_LOW} > 0 AND {_HIGH} > 0 THEN CAST(floor(({_LOW} + {_HIGH}) / 2.0 + 0.5) AS INTEGER) END, CASE WHEN {_ONE} > 0 THEN {_ONE} END, CASE WHEN {_ONE} IS NULL AND {_STAFF} > 0 THEN {_STAFF} END)")})
_projection("STR23_render", "contacts", "contact_id", {"body": (lambda: text.render(F.lit("Hi {{firstName}}, as {{leadRole}} of {{company}} you know {{painPoint}}. {{firstName}}!"), {"firstName": text.first_name(C("full_name")), "leadRole": C("title"), "company": F.concat(F.lit("C"), C("company_id")), "painPoint": F.lit("change")}), "'Hi ' || string_split(full_name, ' ')[1] || ', as ' || title || ' of C' || company_id || ' you know change. ' || string_split(full_name, ' ')[1] || '!'")})
_projection("STR25_snippet", "documents", "doc_id", {"cut": (lambda: text.snippet(C("text")), "CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(substring(text, 1, 499), '\\s+$', '') || '…' END")})
_projection("STR27_suggestions", "searches", "search_id", {"prefix": (lambda: F.startswith(F.lower(C("name")), F.lit("b")), "starts_with(lower(name), 'b')"), "inside": (lambda: F.contains(F.lower(C("name")), F.lit("an")), "contains(lower(name), 'an')"), "distance": (lambda: F.levenshtein(F.lower(C("industry")), F.lit("brand#1")), "levenshtein(lower(industry), 'brand#1')")})
_projection("STR28_initials", "contacts", "contact_id", {"initials": (lambda: F.upper(F.concat(F.substring(text.first_name(C("full_name")), 1, 1), F.substring(text.last_name(C("full_name")), 1, 1))), "'FL'"), "masked": (lambda: F.concat(F.lit("…"), F.right(C("full_name"), F.lit(4))), "'…' || right(full_name, 4)")})
_projection("STR31_messages", "contacts", "contact_id", {"message": (lambda: F.try_element_at(F.create_map(*[F.lit(x) for x in ("valid", "Deliverable", "invalid", "Undeliverable", "catch_all", "Accepts all")]), C("email_status")), "CASE email_status WHEN 'valid' THEN 'Deliverable' WHEN 'invalid' THEN 'Undeliverable' WHEN 'catch_all' THEN 'Accepts all' END")})

_EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_projection("HTM1_emails", "documents", "doc_id", {"emails": (lambda: F.array_join(F.array_sort(text.emails_in(C("text"))), " "), f"array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '{_EMAIL}')), lambda e: NOT regexp_matches(lower(e), 'example\\.com|sentry|\\.png$|\\.jpg$'))), ' ')")})
_projection("HTM1_emails_kept", "documents", "doc_id", {"emails": (lambda: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_EMAIL})"), F.lit(1)))), f"CAST(len(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS INTEGER)")})
_projection("HTM3_technologies", "pages", "page_id", {"technologies": (lambda: F.array_join(text.technologies_in(C("html")), ","), "concat_ws(',', " + ", ".join(f"CASE WHEN {_has('html', p)} THEN '{n}' END" for n, p in fixed.TECHNOLOGY_SIGNS.items()) + ")")})
_projection("HTM4_page_title", "pages", "page_id", {"title": (lambda: text.page_title(C("html")), "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '')")})
_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_projection("HTM6_html_text", "pages", "page_id", {"visible": (lambda: text.html_text(C("html")), _VISIBLE)})
_projection("HTM9_shell", "pages", "page_id", {"shell": (lambda: text.is_shell(C("html")), f"""length(html) < 200 OR (regexp_matches(html, '__NEXT_DATA__|id="root"|id="app"|ng-version|data-reactroot|window\\.__NUXT__|enable javascript|<app-root', 'i') AND length({_VISIBLE}) < 120)""")})
_projection("HTM10_paths", "pages", "page_id", {"paths": (lambda: F.array_join(F.array_sort(text.paths_in(C("html"))), " "), """array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)), lambda p: length(p) <= 120 AND NOT regexp_matches(p, '\\.(png|jpe?g|gif|svg|css|js|pdf|zip|ico)$', 'i'))), ' ')""")})

_TEXT = "lower(concat_ws(' ', nullif(name, ''), nullif(domain, ''), nullif(industry, ''), nullif(description, '')))"
_INDUSTRY = "CASE " + " ".join(f"WHEN {_has(_TEXT, k)} AND NOT {_has(_TEXT, o)} THEN '{label}'" for label, _, k, o in fixed.INDUSTRIES.values()) + " END"
_projection("CLS1_industry", "companies", "company_id", {"detected": (lambda: rules.industry(rules.company_text()), _INDUSTRY)})


def _match_sql(target: str) -> str:
    label, aliases, keywords, others = fixed.INDUSTRIES[target]
    fits = " OR ".join([f"own = '{label.lower()}'", *(f"contains(own, '{a}')" for a in aliases)])
    health = f"WHEN apart AND detected = 'Technology' AND {_has('t', fixed.HEALTH_SOFTWARE)} THEN 0.85 " if target == "healthcare" else ""
    return f"""SELECT company_id, CAST(CASE WHEN other THEN 0 {health}WHEN apart THEN 0.1 WHEN NOT keyword AND NOT fits THEN 0
 ELSE least(1, CASE WHEN coalesce(detected = '{label}', false) THEN greatest(0.9, (fits::INT + keyword::INT) * 0.5) ELSE (fits::INT + keyword::INT) * 0.5 END) END AS DOUBLE) AS score,
 other OR (apart AND NOT ({"detected = 'Technology' AND " + _has('t', fixed.HEALTH_SOFTWARE) if target == "healthcare" else "false"})) AS conflict
 FROM (SELECT *, detected IS NOT NULL AND detected <> '{label}' AND NOT keyword AND NOT fits AS apart FROM (SELECT company_id, {_TEXT} AS t, {_INDUSTRY} AS detected, {_has(_TEXT, keywords)} AS keyword,
 {_has(_TEXT, others)} AS other, ({fits}) AS fits FROM (SELECT *, trim(lower(coalesce(industry, ''))) AS own FROM companies)))"""


for _target in ("technology", "healthcare", "hospitality"):

    @query(f"CLS2_match_{_target}", with_views(_match_sql(_target)))
    def match(spark, sf_dir, target=_target):
        return rules.with_industry_match(model.companies(spark, sf_dir), target).select("company_id", C("m.score").alias("score"), C("m.conflict").alias("conflict"))


@query("FLT1_industry_filter", with_views(f"SELECT company_id FROM ({_match_sql('technology')}) WHERE score >= 0.5"))
def industry_filter(spark, sf_dir):
    return rules.with_industry_match(model.companies(spark, sf_dir), "technology").where("m.score >= 0.5").select("company_id")


_TYPE = f"""CASE WHEN coalesce(domain, '') IN ({", ".join(f"'{d}'" for d in fixed.ACCELERATOR_DOMAINS)}) OR {_has(_TEXT, fixed.ACCELERATOR_NAMES)} THEN 'accelerator'
 WHEN coalesce(domain, '') IN ({", ".join(f"'{d}'" for d in fixed.INVESTMENT_DOMAINS)}) OR {_has(_TEXT, fixed.INVESTMENT_FIRMS)} THEN 'investment_firm' WHEN {_has(_TEXT, fixed.ACCELERATORS)} THEN 'accelerator'
 WHEN {_has(_TEXT, fixed.VENTURE)} AND NOT {_has(_TEXT, fixed.HAS_PRODUCT)} THEN 'vc' {" ".join(f"WHEN {_has(_TEXT, p)} THEN '{k}'" for k, p in fixed.COMPANY_TYPES)} ELSE 'operating_company' END"""
_projection("CLS3_company_type", "companies", "company_id", {"kind": (lambda: rules.company_type(rules.company_text(), C("domain")), _TYPE), "label": (lambda: rules.type_label(rules.company_type(rules.company_text(), C("domain"))), f"CASE {_TYPE} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TYPE_LABELS.items()) + " END")})
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_SCORE = "least(100, " + " + ".join(f"CASE WHEN {_has(_CLEAN.format('description'), p)} THEN {fixed.INTENT_POINTS[s]} ELSE 0 END" for _, s, p in fixed.INTENT_RULES) + ")"
_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(_CLEAN.format('description'), p)} THEN '{r}' END" for r, _, p in fixed.INTENT_RULES) + ")"


def _intent(name: str, source: str, key: str, column: str):
    """score and signals of a table's text, each pattern once a row."""

    def run(spark, sf_dir):
        rows = getattr(model, source)(spark, sf_dir) if source in model.VIEWS else model.table(spark, sf_dir, source)
        rows = rules.with_intent(rows.select(key, column), column)
        return rows.select(key, C("intent.score").alias("score"), F.array_join("intent.signals", ",").alias("signals"))

    run.__name__ = name
    query(name, with_views(f"SELECT {key}, {_SCORE.replace('description', column)} AS score, {_SIGNALS.replace('description', column)} AS signals FROM {source}"))(run)


_intent("CLS5_intent", "companies", "company_id", "description")
_intent("CLS5_intent_documents", "documents", "doc_id", "text")
_MAIL = "coalesce(email <> '', false)"
_PLACE = f"(NOT contains(lower(trim(email)), '@') OR {_has('lower(trim(email))', '(' + '|'.join(fixed.PLACEHOLDER_EMAILS) + ')')})"
_projection("CLS8_display_status", "contacts", "contact_id", {"display": (lambda: rules.display_status(text.email_ok(C("email")), F.when(C("contact_id") % 7 != 0, C("contact_id") % 6 != 0), F.when(C("contact_id") % 5 == 0, "verified").when(C("contact_id") % 5 == 1, "invalid"), C("contact_id") % 2 == 0), f"""CASE WHEN NOT {_OK} OR (contact_id % 7 <> 0 AND contact_id % 6 = 0) THEN 'invalid'
 WHEN contact_id % 2 = 0 THEN CASE WHEN contact_id % 5 = 0 THEN 'likely_valid' WHEN contact_id % 7 <> 0 THEN 'risky' ELSE 'unknown' END
 WHEN contact_id % 5 = 0 THEN 'verified' WHEN contact_id % 5 = 1 THEN 'invalid' WHEN contact_id % 7 <> 0 THEN 'likely_valid' ELSE 'not_found' END""")})
_projection("CLS10_mock_reply", "companies", "company_id", {"replied": (lambda: F.aggregate(F.transform(F.split("name", ""), F.ascii), F.lit(0), lambda a, x: a + x) % 3 == 0, "list_sum(list_transform(string_split(name, ''), lambda c: ascii(c))) % 3 = 0")})
_projection("CLS11_campaign_status", "campaigns", "campaign_id", {"status": (lambda: rules.campaign_status(C("sent_count"), C("failed_count")), "CASE WHEN sent_count = 0 AND failed_count > 0 THEN 'failed' WHEN failed_count > 0 THEN 'partial' ELSE 'completed' END")})
_REL = _chain("title", fixed.TITLE_SCORES, "40")
_projection("SCO1_title_relevance", "contacts", "contact_id", {"score": (lambda: rules.title_relevance(C("title")), _REL)})
_projection("SCO2_contact_confidence", "contacts", "contact_id", {"score": (lambda: rules.contact_confidence(C("title"), C("email"), C("contact_id") % 5 == 0, C("linkedin_url")), f"greatest(0, least(100, {_REL} + CASE WHEN linkedin_url <> '' THEN 12 ELSE 0 END + CASE WHEN {_MAIL} AND contact_id % 5 <> 0 THEN 18 WHEN contact_id % 5 = 0 THEN -8 ELSE 0 END))")})
_CONF = "least(100, 45 + CASE WHEN domain <> '' THEN 15 ELSE 0 END + CASE WHEN length(description) > 40 THEN 15 ELSE 0 END + CASE WHEN industry <> '' THEN 10 ELSE 0 END + CASE WHEN linkedin_url <> '' THEN 10 ELSE 0 END + CASE WHEN employee_count <> 0 THEN 5 ELSE 0 END + CASE WHEN starts_with(website_url, 'http') THEN 5 ELSE 0 END)"
_projection("SCO3_company_confidence", "companies", "company_id", {"score": (lambda: rules.company_confidence(*[C(c) for c in ("domain", "description", "industry", "linkedin_url", "employee_count", "website_url")]), _CONF)})
_projection("SCO9_category", "contacts", "contact_id", {"category": (lambda: rules.quality_category(C("confidence")), "CASE WHEN confidence >= 90 THEN 'excellent' WHEN confidence >= 75 THEN 'good' WHEN confidence >= 50 THEN 'average' ELSE 'reject' END")})
_projection("FLT3_size", "companies", "company_id", {"fits": (lambda: rules.size_matches(C("employee_count"), 50, 500), "coalesce(employee_count BETWEEN 50 AND 500, false)"), "open": (lambda: rules.size_matches(C("employee_count"), None, None), "true")})
_TECH = lambda w: f"(len(list_filter(technologies, lambda t: contains(lower(t), '{w}') OR contains('{w}', lower(t)))) > 0 OR coalesce(contains({_TEXT}, '{w}'), false))"
_projection("FLT4_technologies", "companies", "company_id", {"fits": (lambda: rules.technologies_match(C("technologies"), rules.company_text(), ["React", "Python"]), f"{_TECH('react')} AND {_TECH('python')}"), "saas": (lambda: rules.technologies_match(C("technologies"), rules.company_text(), ["SaaS"]), _TECH("saas"))})
_projection("FLT9_exclusions", "companies", "company_id", {"kept": (lambda: F.lit(True), "true")}, (lambda: ~F.coalesce(F.lower("industry").isin("building"), F.lit(False)) & ~F.coalesce(C("country").contains("NATION_1"), F.lit(False)) & ~F.lower(F.concat_ws(" ", "name", "industry")).contains("machinery"), "NOT coalesce(lower(industry) = 'building', false) AND NOT coalesce(contains(country, 'NATION_1'), false) AND NOT contains(lower(concat_ws(' ', name, industry)), 'machinery')"))
_projection("FLT18_confidence_gate", "contacts", "contact_id", {"confidence": (lambda: C("confidence"), "confidence")}, (lambda: C("confidence") >= F.when(C("contact_id") % 2 == 0, 25).otherwise(35), "confidence >= CASE WHEN contact_id % 2 = 0 THEN 25 ELSE 35 END"))
_projection("FLT21_profile_kinds", "companies", "company_id", {"company_page": (lambda: F.coalesce(C("linkedin_url").contains("/company/") & ~C("linkedin_url").contains("/school/"), F.lit(False)), "coalesce(contains(linkedin_url, '/company/') AND NOT contains(linkedin_url, '/school/'), false)")})
_projection("FLT22_saved_searches", "searches", "search_id", {"name": (lambda: C("name"), "name")}, (lambda: (C("status") == "active") & (C("name").contains("a") | F.exists("keywords", lambda k: k.contains("b"))), "status = 'active' AND (contains(name, 'a') OR len(list_filter(keywords, lambda k: contains(k, 'b'))) > 0)"))
_projection("FLT23_list_filter", "contacts", "contact_id", {"title": (lambda: C("title"), "title")}, (lambda: F.lower(F.concat_ws(" ", "full_name", "title", "email")).contains("first12 "), "contains(lower(concat_ws(' ', full_name, title, email)), 'first12 ')"))
_projection("FLT29_reply_subject", "conversations", "conv_id, turn".split(", ")[0], {"reply": (lambda: C("text").rlike("(?i)^(re|fwd):"), "regexp_matches(text, '^(re|fwd):', 'i')"), "turn": (lambda: C("turn"), "turn")})

_FACTORS = f"""SELECT c.contact_id, m.score AS industry, CASE WHEN m.conflict THEN 0.0 WHEN m.score >= 0.5 THEN 1.0 ELSE 0.2 END AS kind,
 CASE WHEN employee_count IS NULL THEN 0.45 WHEN employee_count BETWEEN 50 AND 500 THEN 1.0 ELSE 0.0 END AS size, CASE WHEN country = 'NATION_3' THEN 1.0 ELSE 0.0 END AS place,
 CASE WHEN {_has('title', 'ceo|chief executive|founder')} THEN 1.0 ELSE 0.0 END AS role, ({_TECH('react')}::INT + {_TECH('python')}::INT) / 2.0 AS tech, {_SCORE} AS intent
 FROM contacts c JOIN companies USING (company_id) JOIN ({_match_sql('technology')}) m USING (company_id) WHERE NOT discarded"""


def factors(spark, sf_dir):
    """Per company once, then joined to its contacts: the costly patterns run on the smaller table."""
    tech = (F.when(rules.technologies_match(C("technologies"), rules.company_text(), ["React"]), 1).otherwise(0) + F.when(rules.technologies_match(C("technologies"), rules.company_text(), ["Python"]), 1).otherwise(0)) / 2.0
    per_company = rules.with_industry_match(model.companies(spark, sf_dir), "technology").select("company_id", "m", "employee_count", "country", tech.alias("tech"), F.coalesce(rules.intent_score(C("description")), F.lit(0)).alias("intent")).select(
        "company_id",
        C("m.score").alias("industry"),
        F.when(C("m.conflict"), 0.0).when(C("m.score") >= 0.5, 1.0).otherwise(0.2).alias("kind"),
        F.when(C("employee_count").isNull(), 0.45).when(rules.size_matches(C("employee_count"), 50, 500), 1.0).otherwise(0.0).alias("size"),
        F.when(C("country") == "NATION_3", 1.0).otherwise(0.0).alias("place"),
        C("tech").cast("double").alias("tech"),
        "intent",
    )
    people = model.contacts(spark, sf_dir).where("not discarded").select("contact_id", "company_id", F.when(text.has(C("title"), "ceo|chief executive|founder"), 1.0).otherwise(0.0).alias("role"))
    return people.join(per_company, "company_id")


@query("SCO6_factors", with_views(f"SELECT contact_id, industry, CAST(kind AS DOUBLE) AS kind, CAST(size AS DOUBLE) AS size, CAST(place AS DOUBLE) AS place, CAST(role AS DOUBLE) AS role, CAST(tech AS DOUBLE) AS tech FROM ({_FACTORS})"))
def lead_factors(spark, sf_dir):
    return factors(spark, sf_dir).select("contact_id", "industry", "kind", "size", "place", "role", "tech")


_LEAD_SCORE = f"SELECT contact_id, CAST(least(10, greatest(1, least(10, floor(1 + (industry * 18 + kind * 18 + size * 16 + place * 16 + role * 16 + tech * 16) / 100 * 9 + 0.5))) + CASE WHEN intent >= 70 THEN 1 WHEN intent >= 45 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score FROM ({_FACTORS})"


@query("SCO10_score_leads", with_views(_LEAD_SCORE))
def lead_scores(spark, sf_dir):
    f = {"industry": C("industry"), "type": C("kind"), "size": C("size"), "location": C("place"), "role": C("role"), "technology": C("tech")}
    return factors(spark, sf_dir).select("contact_id", rules.lead_score(f, intent=C("intent")).alias("score"))


@query("SCO7_lead_score", with_views(f"SELECT contact_id, CAST(greatest(1, least(10, floor(1 + (industry * 18 + kind * 18 + size * 16 + place * 16 + role * 16 + tech * 16) / 100 * 9 + 0.5))) AS DOUBLE) AS score FROM ({_FACTORS})"))
def lead_score(spark, sf_dir):
    """The formula alone, without what intent adds."""
    f = {"industry": C("industry"), "type": C("kind"), "size": C("size"), "location": C("place"), "role": C("role"), "technology": C("tech")}
    return factors(spark, sf_dir).select("contact_id", rules.lead_score(f).alias("score"))


@query("AGG20_weighted_mean", with_views(f"SELECT contact_id, floor((industry * 18 + kind * 18 + size * 16 + place * 16 + role * 16 + tech * 16) / 100 * 1000 + 0.5) / 1000 AS mean FROM ({_FACTORS})"))
def weighted_mean(spark, sf_dir):
    total = C("industry") * 18 + C("kind") * 18 + C("size") * 16 + C("place") * 16 + C("role") * 16 + C("tech") * 16
    return factors(spark, sf_dir).select("contact_id", (F.floor(total / 100 * 1000 + 0.5) / 1000).alias("mean"))

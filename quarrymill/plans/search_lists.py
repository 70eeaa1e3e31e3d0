"""Every company against the lists of its own search: keywords, and exclusions with their count."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import relevance as R
from ..functions import search_lists as L
from ..functions.text import has
from ..registry import SQL, query
from ..sources import model
from ..sources.cases import literal, sql_literal
from ..sources.model import with_views
from .by_search import _JUDGED, A_SEARCH, TARGETS, blockers, judged

C = F.col
KEYWORDS = [["software"], ["B2B", " software "], ["healthtech", "medical"], ["b2b"], [], ["cloud", " "], ["startup", "hotel"], ["patient", "clinical", "digital health"], ["tech"], ["saas", "medical"]]
INDUSTRIES = [[], ["Building"], ["auto", "FURNITURE"]]
COUNTRIES = [["nation_1"], [], ["NATION_22", "nation_7"], []]
WORDS = [[], ["machinery"], ["#00000000", "house"], [], ["0000001"]]


def _pick_sql(values: list, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {sql_literal(v)}" for i, v in enumerate(values)) + " END"


_SEARCH = f"(company_id // {A_SEARCH})"
_LISTED = f"""SELECT c.*, {_SEARCH} AS search, {_pick_sql(KEYWORDS, _SEARCH)} AS keywords, {_pick_sql(INDUSTRIES, _SEARCH)} AS industries, {_pick_sql(COUNTRIES, _SEARCH)} AS countries, {_pick_sql(WORDS, _SEARCH)} AS words,
 ['customer-' || lpad(({_SEARCH} * {A_SEARCH} + 2)::VARCHAR, 9, '0') || '.example'] AS domains FROM companies c JOIN searches s ON s.search_id = {_SEARCH}"""
_SYNONYMS = "CASE w " + " ".join(f"WHEN '{k}' THEN {sql_literal(v)}" for k, v in fixed.KEYWORD_SYNONYMS.items()) + " ELSE []::VARCHAR[] END"
_HEALTH = sql_literal(fixed.KEYWORD_SYNONYMS["healthtech"] + fixed.KEYWORD_SYNONYMS["healthcare"])


def listed(spark, sf_dir):
    """Companies with the lists of their search; a search is joined by key."""
    search = F.floor(C("company_id") / A_SEARCH).cast("long")
    pick = lambda values: F.element_at(F.array(*map(literal, values)), (search % len(values) + 1).cast("int"))
    searches = model.searches(spark, sf_dir).select(C("search_id").cast("long").alias("search"))
    found = model.companies(spark, sf_dir).drop("search_id").withColumn("search", search).join(searches, "search")
    domain = F.concat(F.lit("https://www.Customer-"), F.lpad((search * A_SEARCH + 2).cast("string"), 9, "0"), F.lit(".example/about"))
    return found.withColumns({"keywords": pick(KEYWORDS), "industries": pick(INDUSTRIES), "countries": pick(COUNTRIES), "words": pick(WORDS), "domains": F.array(domain)})


@query(
    "FLT7_keywords_by_search",
    with_views(f"""SELECT company_id, CASE WHEN len(k) > 1 AND len(list_filter(k, lambda w: NOT (regexp_matches(w, '{fixed.HEALTH_CLUSTER}') OR list_contains({_HEALTH}, w)))) = 0 THEN len(hit) > 0 ELSE len(hit) = len(k) END AS fits
 FROM (SELECT *, list_filter(k, lambda w: contains(t, w) OR len(list_filter({_SYNONYMS}, lambda s: contains(t, s))) > 0) AS hit
 FROM (SELECT company_id, t, CASE WHEN list_has_any(k, {sql_literal(fixed.SOFTWARE_KEYWORDS)}) THEN list_filter(k, lambda w: w <> 'b2b') ELSE k END AS k
 FROM (SELECT company_id, lower(concat_ws(' ', nullif(name, ''), nullif(domain, ''), nullif(description, ''), nullif(industry, ''))) AS t, list_filter(list_transform(keywords, lambda w: lower(trim(w))), lambda w: w <> '') AS k FROM ({_LISTED}))))"""),
)
def keywords(spark, sf_dir):
    """Whether a company has the keywords of its search."""
    text = L.company_text(C("name"), C("domain"), C("description"), C("industry"))
    return listed(spark, sf_dir).withColumn("text", text).select("company_id", L.keywords_match(C("text"), C("keywords")).alias("fits"))


_OUT = """coalesce(list_contains(domains, domain), false) OR len(list_filter(industries, lambda w: contains(lower(coalesce(industry, '')), lower(w)))) > 0
 OR len(list_filter(countries, lambda w: contains(lower(coalesce(country, '')), lower(w)))) > 0 OR len(list_filter(words, lambda w: contains(lower(coalesce(name, '') || ' ' || coalesce(industry, '')), lower(w)))) > 0"""


def _out():
    return L.excluded(C("name"), C("domain"), C("industry"), C("country"), C("domains"), C("industries"), C("words"), C("countries"))


@query("FLT9_exclusions_by_search", with_views(f"SELECT company_id FROM ({_LISTED}) WHERE NOT ({_OUT})"))
def exclusions(spark, sf_dir):
    """Companies that none of their search's four lists leaves out."""
    return listed(spark, sf_dir).where(~_out()).select("company_id")


@query("FLT9_excluded_counts", with_views(f"SELECT search, count(*) AS companies, count(*) FILTER ({_OUT}) AS excluded FROM ({_LISTED}) GROUP BY search"))
def excluded_counts(spark, sf_dir):
    """How many companies of each search its lists leave out."""
    return listed(spark, sf_dir).groupBy("search").agg(F.count("*").alias("companies"), F.count_if(_out()).alias("excluded"))


_TARGET = _pick_sql(TARGETS, _SEARCH)
_TEXT = "lower(concat_ws(' ', nullif(name, ''), nullif(domain, ''), nullif(industry, ''), nullif(description, '')))"
# fixed values: what a search for technology, and one for SaaS, says
_TECH_SEARCH = r"\btech(nology)?\b|software|saas|it services|startup"
_SAAS_TARGET, _SAAS_KEYWORD = r"\bsaas\b|software as a service|b2b software|cloud software", r"\b(saas|software as a service|b2b software|cloud software)\b"


def _said(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, '{pattern}', 'i'), false)"


_TECH = _said("target || ' ' || array_to_string(keywords, ' ')", _TECH_SEARCH)
_SAAS = f"({_said('target', _SAAS_TARGET)} OR len(list_filter(keywords, lambda w: {_said('trim(w)', _SAAS_KEYWORD)})) > 0)"
_STRONG = f"CASE WHEN saas THEN {_said('t', R.STRONG_SAAS)} OR {_said('industry', r'\bsaas\b|\bsoftware\b')} ELSE {_said('t', R.STRONG_TECH)} OR {_said('industry', r'\btechnology\b|\bsoftware\b|\bsaas\b')} END"
_RELEVANCE = f"""SELECT company_id, tech, fits, coalesce(blocked, CASE WHEN NOT fits THEN 'keyword_mismatch' WHEN (tech OR saas) AND {_said('t', R.CONGLOMERATE)} THEN 'enterprise_conglomerate'
  WHEN (tech OR saas) AND NOT ({_STRONG}) AND NOT (len(list_filter(keywords, lambda w: {_said('w', r'\b(software|saas|b2b)\b')})) > 0 AND {_said('t', r'\bsoftware\b')}) THEN 'weak_tech_signal' END) AS reason
 FROM (SELECT *, {_TECH} AS tech, {_SAAS} AS saas FROM (SELECT company_id, industry, keywords, {_TARGET} AS target, {_TEXT} AS t FROM ({_LISTED})))
 JOIN ({SQL["FLT7_keywords_by_search"]}) USING (company_id) JOIN (SELECT company_id, reason AS blocked FROM ({SQL["FLT5_blockers_by_search"]})) USING (company_id)"""


def relevance(spark, sf_dir):
    """company_id, tech (the search is for technology), fits (the keywords), reason (the first against the company, or null)."""
    target = F.element_at(F.array(*map(F.lit, TARGETS)), (C("search") % len(TARGETS) + 1).cast("int"))
    rows = listed(spark, sf_dir).withColumns({"text": L.company_text(C("name"), C("domain"), C("industry"), C("description")), "target": target})
    tech = F.lower(F.concat(C("target"), F.lit(" "), F.array_join("keywords", " "))).rlike(_TECH_SEARCH)
    saas = has(C("target"), _SAAS_TARGET) | F.exists("keywords", lambda w: has(F.trim(w), _SAAS_KEYWORD))
    rows = rows.select("company_id", "industry", "text", "keywords", tech.alias("tech"), saas.alias("saas"), L.keywords_match(C("text"), C("keywords")).alias("fits"))
    strong = F.when(C("saas"), R.strong_signal(C("text"), C("industry"), True)).otherwise(R.strong_signal(C("text"), C("industry"), False))
    software = F.exists("keywords", lambda w: has(w, r"\b(software|saas|b2b)\b")) & has(C("text"), r"\bsoftware\b")
    soft = F.when(~C("fits"), "keyword_mismatch").when((C("tech") | C("saas")) & has(C("text"), R.CONGLOMERATE), "enterprise_conglomerate").when((C("tech") | C("saas")) & ~strong & ~software, "weak_tech_signal")
    blocked = blockers(spark, sf_dir).select("company_id", C("reason").alias("blocked"))
    return rows.join(blocked, "company_id").select("company_id", "tech", "fits", F.coalesce("blocked", soft).alias("reason"))


@query("FLT6_relevance_by_search", with_views(f"SELECT company_id, reason FROM ({_RELEVANCE})"))
def relevance_reasons(spark, sf_dir):
    """Why a company is not relevant for its own search: a hard blocker, its keywords, its size, or too little technology."""
    return relevance(spark, sf_dir).select("company_id", "reason")


_PARTS = """floor(score * 28 + 0.5)::BIGINT AS industry, CASE WHEN fits THEN 18 ELSE 9 END AS keywords, CASE WHEN trim(target_country) = '' OR (coalesce(trim(country), '') <> '' AND in_country) THEN 18 WHEN coalesce(trim(country), '') <> '' THEN 5 WHEN in_country THEN 15 ELSE 10 END AS location,
 CASE WHEN size_min IS NULL AND size_max IS NULL THEN 14 WHEN employee_count IS NULL THEN 5 WHEN in_size THEN 14 ELSE 0 END AS size, floor(least(1, coalesce(confidence, 0) / 100.0) * 12 + 0.5)::BIGINT AS quality, CASE WHEN linkedin_url <> '' THEN 5 ELSE 3 END AS linkedin, CASE WHEN tech AND score < 0.5 THEN 2 ELSE 5 END AS business"""
_FACTORS = ["industry", "keywords", "location", "size", "quality", "linkedin", "business"]


@query(
    "SCO4_breakdown_by_search",
    with_views(f"""SELECT company_id, {", ".join(f"{f}::BIGINT AS {f}" for f in _FACTORS)}, (CASE WHEN reason IS NULL THEN least(100, {" + ".join(_FACTORS)}) ELSE floor(least(100, {" + ".join(_FACTORS)}) * 0.7::DOUBLE + 0.5) END)::BIGINT AS overall
 FROM (SELECT company_id, reason, {_PARTS} FROM ({_JUDGED}) JOIN ({_RELEVANCE}) USING (company_id) JOIN (SELECT company_id, country FROM companies) USING (company_id))"""),
)
def breakdown(spark, sf_dir):
    """The seven factors of the fit, each rounded by itself, and their sum, three tenths less for companies that are not relevant."""
    up = lambda c: F.floor(c + 0.5).cast("long")
    rows = judged(spark, sf_dir).join(relevance(spark, sf_dir), "company_id")
    there = F.trim(F.coalesce("country", F.lit(""))) != ""
    free = C("size_min").isNull() & C("size_max").isNull()
    parts = {
        "industry": up(C("m.score") * 28),
        "keywords": F.when(C("fits"), 18).otherwise(9),
        "location": F.when((F.trim("target_country") == "") | (there & C("in_country")), 18).when(there, 5).when(C("in_country"), 15).otherwise(10),
        "size": F.when(free, 14).when(C("employee_count").isNull(), 5).when(C("in_size"), 14).otherwise(0),
        "quality": up(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0)) / 100.0) * 12),
        "linkedin": F.when(C("linkedin_url") != "", 5).otherwise(3),
        "business": F.when(C("tech") & (C("m.score") < 0.5), 2).otherwise(5),
    }
    rows = rows.select("company_id", "reason", *[c.cast("long").alias(n) for n, c in parts.items()])
    total = F.least(F.lit(100), sum((C(f) for f in _FACTORS[1:]), C(_FACTORS[0])))
    return rows.select("company_id", *_FACTORS, F.when(C("reason").isNull(), total).otherwise(up(total * 0.7)).cast("long").alias("overall"))

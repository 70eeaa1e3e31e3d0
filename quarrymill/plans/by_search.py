"""Queries that hold companies and contacts against the search that found them: criteria are columns of a joined table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import countries, rules, titles
from ..functions import relevance as R
from ..registry import query
from ..sources import model
from ..sources.cases import case_query, literal, sql_literal
from ..sources.model import with_views
from ..sources.staging import staged
from .functions import _TEXT, _TYPE, C, _chain, _has, _match_sql
from .matching import NO_TIER
from .relevance import _BLOCK, _INVESTOR, _MEDIA

#: Criteria that searches take by turns, so that all kinds occur on every table.
TARGETS = ["technology", "healthcare", "finance", "retail", "hospitality", "media", "real_estate"]
COUNTRIES = ["NATION_3", "USA", "Germany", "nation_1", ""]
SIZES = [(50, 500), (None, 300), (100, None), (None, None)]
TECHNOLOGIES = [["React"], ["Python", "Stripe"], [], ["cloud"]]
TITLES = [["CTO"], ["CEO", "Founder"], ["VP  Engineering"], ["Manager"], [], ["Office Manager", "owner"]]
#: Companies of a search follow one another in the table; every search of `part` is read.
A_SEARCH = 7


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, target, target_country, size_min, size_max, wanted (technologies), titles."""
    key = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(literal, values)), (key % len(values) + 1).cast("int"))
    return model.table(spark, sf_dir, "part").select(key.alias("search_id"), pick(TARGETS).alias("target"), pick(COUNTRIES).alias("target_country"), pick([s[0] for s in SIZES]).alias("size_min"), pick([s[1] for s in SIZES]).alias("size_max"), pick(TECHNOLOGIES).alias("wanted"), pick(TITLES).alias("titles"))


def _pick_sql(values: list) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(values)} = {i} THEN {sql_literal(v)}" for i, v in enumerate(values)) + " END"


_SEARCHES = f"""SELECT p_partkey AS search_id, {_pick_sql(TARGETS)} AS target, {_pick_sql(COUNTRIES)} AS target_country, {_pick_sql([s[0] for s in SIZES])} AS size_min, {_pick_sql([s[1] for s in SIZES])} AS size_max,
 {_pick_sql(TECHNOLOGIES)} AS wanted, {_pick_sql(TITLES)} AS titles FROM part"""
_OWN_SEARCH = f"(company_id // {A_SEARCH})"


def found_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the criteria of their search; searches are the small side of an ordinary equi-join."""
    found = model.companies(spark, sf_dir).withColumn("search_id", F.floor(C("company_id") / A_SEARCH).cast("long"))
    return found.join(searches(spark, sf_dir).withColumn("search_id", C("search_id").cast("long")), "search_id")


def size_fits() -> Column:
    """No bound passes all; an unknown size passes none."""
    free = C("size_min").isNull() & C("size_max").isNull()
    inside = C("employee_count").isNotNull() & (C("employee_count") >= F.coalesce("size_min", F.lit(0))) & (C("employee_count") <= F.coalesce("size_max", F.lit(2**31 - 1)))
    return free | inside


def _has_technology(wanted: Column) -> Column:
    have, low = F.coalesce("technologies", F.array().cast("array<string>")), F.lower(wanted)
    return F.exists(have, lambda t: F.lower(t).contains(low) | low.contains(F.lower(t))) | F.coalesce(C("text").contains(low), F.lit(False))


def technologies_fit() -> Column:
    return F.forall("wanted", _has_technology)


def technology_share() -> Column:
    """Which share of the wanted ones a company has; all of none."""
    return F.when(F.size("wanted") == 0, 1.0).otherwise(F.size(F.filter("wanted", _has_technology)) / F.size("wanted"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test of a company against its own search, each once a row."""
    rows = rules.with_industry_match(found_companies(spark, sf_dir), C("target")).withColumn("text", rules.company_text())
    return rows.withColumns({"technology_share": technology_share(), "kind": rules.company_type(C("text"), C("domain")), "in_country": countries.matches_any(C("country"), C("target_country"), C("domain"), C("description")), "in_size": size_fits(), "has_technologies": technologies_fit()})


_ALIASES = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in countries.ALIASES.items()) + "}"
_TLDS = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in countries.TLDS.items()) + "}"
_NORM = lambda c: f"coalesce({_ALIASES}[trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))], trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g')))"
_OWNED = "(len(list_filter(technologies, lambda t_: contains(lower(t_), lower(w)) OR contains(lower(w), lower(t_)))) > 0 OR coalesce(contains(t, lower(w)), false))"
_JUDGED = f"""SELECT company_id, target, target_country, size_min, size_max, employee_count, confidence, domain, linkedin_url, t, kind, score, conflict,
 (name_ = '' OR (own <> '' AND (contains(own, name_) OR contains(name_, own))) OR contains(low, name_) OR len(list_filter(map_keys({_ALIASES}), lambda a: {_ALIASES}[a] = name_ AND contains(low, a))) > 0
  OR coalesce(contains(hint, name_) OR contains(name_, hint), false)) AS in_country,
 ((size_min IS NULL AND size_max IS NULL) OR coalesce(employee_count >= coalesce(size_min, 0) AND employee_count <= coalesce(size_max, 2147483647), false)) AS in_size,
 len(list_filter(wanted, lambda w: NOT {_OWNED})) = 0 AS has_technologies, CASE WHEN len(wanted) = 0 THEN 1.0 ELSE len(list_filter(wanted, lambda w: {_OWNED})) / len(wanted)::DOUBLE END AS technology_share
 FROM (SELECT c.*, s.* EXCLUDE search_id, {_TEXT} AS t, {_TYPE} AS kind, {_NORM('country')} AS own, {_NORM('target_country')} AS name_, lower(concat_ws(' ', nullif(description, ''), nullif(domain, ''))) AS low,
  CASE WHEN contains(domain, '.') THEN {_TLDS}[string_split(lower(domain), '.')[-1]] END AS hint
  FROM companies c JOIN ({_SEARCHES}) s ON s.search_id = company_id // {A_SEARCH})
 JOIN ({" UNION ALL ".join(f"SELECT *, '{t}' AS target FROM ({_match_sql(t)})" for t in TARGETS)}) USING (company_id, target)"""


@query("FLT2_criteria_by_search", with_views(f"SELECT company_id, score, conflict, in_country, in_size, has_technologies, score >= 0.5 AND in_country AND in_size AND has_technologies AS fits FROM ({_JUDGED})"))
def criteria(spark, sf_dir):
    fits = (C("m.score") >= 0.5) & C("in_country") & C("in_size") & C("has_technologies")
    return judged(spark, sf_dir).select("company_id", C("m.score").alias("score"), C("m.conflict").alias("conflict"), "in_country", "in_size", "has_technologies", fits.alias("fits"))


_NO_CUSTOMERS = ["vc", "accelerator", "investment_firm", "news_media", "community"]
_REASONS = f"""concat_ws(';', CASE WHEN kind IN ({", ".join(f"'{k}'" for k in _NO_CUSTOMERS)}) THEN 'company type' END, CASE WHEN score < 0.5 THEN 'industry' END, CASE WHEN NOT in_country THEN 'country' END,
 CASE WHEN employee_count IS NOT NULL AND NOT in_size THEN 'size' END)"""


def reasons():
    tests = {"company type": C("kind").isin(_NO_CUSTOMERS), "industry": C("m.score") < 0.5, "country": ~C("in_country"), "size": C("employee_count").isNotNull() & ~C("in_size")}
    return F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])), ";")


@query("FLT10_validation_by_search", with_views(f"SELECT company_id, {_REASONS} AS reasons, employee_count IS NULL AS size_unknown FROM ({_JUDGED})"))
def validation(spark, sf_dir):
    return judged(spark, sf_dir).select("company_id", reasons().alias("reasons"), C("employee_count").isNull().alias("size_unknown"))


_TIER = "CASE WHEN reasons = '' THEN 0 WHEN score >= 0.12 THEN 1 WHEN reasons IN ('industry', 'country', 'size') THEN 2 WHEN score >= 0.1 THEN 3 END"
WANTED = 30


@query(
    "FLT11_tiers_by_search",
    with_views(f"""SELECT search_id, company_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY tier, confidence DESC, company_id) AS nth FROM (
 SELECT *, {_TIER} AS tier, row_number() OVER (PARTITION BY search_id, coalesce(domain, 'id' || company_id) ORDER BY {_TIER}, confidence DESC, company_id) AS once
 FROM (SELECT *, {_REASONS} AS reasons, {_OWN_SEARCH} AS search_id FROM ({_JUDGED})) WHERE {_TIER} IS NOT NULL) WHERE once = 1) WHERE tier = 0 OR nth <= {WANTED}"""),
)
def tiers(spark, sf_dir):
    """All accepted companies of a search; relaxed tiers only fill it up to thirty.

    A search may have found any number: what can only fill up is first cut to thirty of each range of its companies, by
    partial ranks, so no search is one task's window as a whole; accepted rows pass by and are only counted.
    """
    rows = judged(spark, sf_dir).withColumn("reasons", reasons()).withColumn("search_id", C("search_id").cast("long"))
    tier = F.when(C("reasons") == "", 0).when(C("m.score") >= 0.12, 1).when(C("reasons").isin("industry", "country", "size"), 2).when(C("m.score") >= 0.1, 3).otherwise(NO_TIER)
    rows = rows.withColumn("tier", tier).select("search_id", "company_id", "tier", "confidence", "domain")
    order = ["tier", F.desc("confidence"), "company_id"]
    once = Window.partitionBy("search_id", F.coalesce("domain", F.concat(F.lit("id"), "company_id"))).orderBy(*order)
    rows = rows.withColumn("once", F.row_number().over(once)).where((C("once") == 1) & (C("tier") < NO_TIER))
    rows = staged(rows.drop("once", "domain"), "tiers")
    accepted = rows.where("tier = 0").select("search_id", "company_id", "tier")
    count = accepted.groupBy("search_id").agg(F.count("*").alias("n"))
    part = Window.partitionBy("search_id", F.pmod(F.xxhash64("company_id"), F.lit(64))).orderBy(*order)
    first = rows.where("tier > 0").withColumn("nth", F.row_number().over(part)).where(f"nth <= {WANTED}")
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("search_id").orderBy(*order))).where(f"nth <= {WANTED}")
    fill = ranked.join(count, "search_id", "left").where(C("nth") <= WANTED - F.coalesce("n", F.lit(0)))
    return accepted.union(fill.select("search_id", "company_id", "tier"))


@query(
    "SCO4_fit_by_search",
    with_views(f"""SELECT company_id, CAST(least(100, floor(score * 28 + 0.5) + CASE WHEN target_country = '' THEN 18 WHEN in_country THEN 18 ELSE 5 END
 + CASE WHEN employee_count IS NULL THEN 5 WHEN in_size THEN 14 ELSE 0 END + floor(least(1, confidence / 100.0) * 12 + 0.5) + CASE WHEN linkedin_url <> '' THEN 5 ELSE 3 END + CASE WHEN score >= 0.5 THEN 5 ELSE 2 END) AS BIGINT) AS fit FROM ({_JUDGED})"""),
)
def fit(spark, sf_dir):
    """The factors of the fit that depend on a search, each rounded by itself, against the search's own criteria."""
    up = lambda c: F.floor(c + 0.5)
    size = F.when(C("employee_count").isNull(), 5).when(C("in_size"), 14).otherwise(0)
    total = up(C("m.score") * 28) + F.when(C("in_country"), 18).otherwise(5) + size + up(F.least(F.lit(1.0), C("confidence") / 100.0) * 12) + F.when(C("linkedin_url") != "", 5).otherwise(3) + F.when(C("m.score") >= 0.5, 5).otherwise(2)
    return judged(spark, sf_dir).select("company_id", F.least(F.lit(100), total).cast("long").alias("fit"))


_ROLES = "MAP {" + ", ".join(f"'{role}': {sql_literal(names)}" for role, names in titles.ROLES.items()) + "}"
_CLEAN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_UNKNOWN = ", ".join(f"'{t}'" for t in titles.UNKNOWN_TITLES)
_HELD = f"""SELECT *, t NOT IN ({_UNKNOWN}) AND NOT ({_has('t', titles.NO_DECISION)} OR ({_has('t', titles.NO_EXECUTIVE)} AND NOT {_has('t', titles.STILL_EXECUTIVE)}) OR (list_contains(keys, 'manager') AND {_has('t', '\\bmanager\\b')} AND NOT {_has('t', titles.EXECUTIVE_MANAGERS)}))
 AND (len(list_filter(roles, lambda r: CASE WHEN contains(r, ' ') THEN contains(t, r) ELSE regexp_matches(t, '\\b' || r || '\\b') END)) > 0 OR (len(list_filter(keys, lambda k: contains(k, 'vp engineering'))) > 0 AND {_has('t', titles.VP_ENGINEERING)})) AS fits
 FROM (SELECT *, flatten(list_transform(keys, lambda k: coalesce({_ROLES}[k], [k]))) AS roles
 FROM (SELECT contact_id, company_id, full_name, title, {_CLEAN.format('title')} AS t, list_transform(CASE WHEN len(titles) > 0 THEN titles ELSE {sql_literal(titles.DEFAULT_TITLES)} END, lambda w: {_CLEAN.format('w')}) AS keys
 FROM contacts JOIN ({_SEARCHES}) s ON s.search_id = {_OWN_SEARCH}))"""


@query("FLT17_titles_by_search", with_views(f"SELECT contact_id, company_id, fits, {_chain('title', titles.DECISION_RANKS, '0')} AS rank FROM ({_HELD})"))
def titles_by_search(spark, sf_dir):
    c = model.contacts(spark, sf_dir).withColumn("search_id", F.floor(C("company_id") / A_SEARCH).cast("long"))
    rows = c.join(searches(spark, sf_dir).select(C("search_id").cast("long").alias("search_id"), "titles"), "search_id")
    return rows.select("contact_id", "company_id", titles.title_matches_any(C("title"), C("titles")).alias("fits"), titles.decision_rank(C("title")).alias("rank"))


_FACTORS = f"""SELECT contact_id, score AS industry, CAST(CASE WHEN conflict THEN 0.0 WHEN score >= 0.5 THEN 1.0 ELSE 0.2 END AS DOUBLE) AS kind,
 CAST(CASE WHEN size_min IS NULL AND size_max IS NULL THEN 1.0 WHEN employee_count IS NULL THEN 0.45 WHEN in_size THEN 1.0 ELSE 0.0 END AS DOUBLE) AS size, CAST(in_country AS DOUBLE) AS place,
 CAST(len(titles) = 0 OR fits AS DOUBLE) AS role, CAST(technology_share AS DOUBLE) AS tech
 FROM ({_HELD.replace("contact_id, company_id, full_name, title,", "contact_id, company_id, full_name, title, titles,")}) JOIN ({_JUDGED}) USING (company_id)"""


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six factors of each contact, from 0 to 1: a company's five are made once, then joined to its contacts."""
    open_size = C("size_min").isNull() & C("size_max").isNull()
    firm = judged(spark, sf_dir).select(
        "company_id",
        C("m.score").alias("industry"),
        F.when(C("m.conflict"), 0.0).when(C("m.score") >= 0.5, 1.0).otherwise(0.2).alias("kind"),
        F.when(open_size, 1.0).when(C("employee_count").isNull(), 0.45).when(C("in_size"), 1.0).otherwise(0.0).alias("size"),
        C("in_country").cast("double").alias("place"),
        "titles",
        C("technology_share").cast("double").alias("tech"),
    )
    c = model.contacts(spark, sf_dir).select("contact_id", "company_id", "title").join(firm, "company_id")
    role = (F.size("titles") == 0) | titles.title_matches_any(C("title"), C("titles"))
    return c.select("contact_id", "industry", "kind", "size", "place", role.cast("double").alias("role"), "tech")


@query("SCO6_factors_by_search", with_views(_FACTORS))
def lead_factors(spark, sf_dir):
    return factors(spark, sf_dir)


@query("SCO7_scores_by_search", with_views(f"SELECT contact_id, CAST(greatest(1, least(10, floor(1 + (industry * 18 + kind * 18 + size * 16 + place * 16 + role * 16 + tech * 16) / 100 * 9 + 0.5))) AS DOUBLE) AS score FROM ({_FACTORS})"))
def lead_scores(spark, sf_dir):
    f = {"industry": C("industry"), "type": C("kind"), "size": C("size"), "location": C("place"), "role": C("role"), "technology": C("tech")}
    return factors(spark, sf_dir).select("contact_id", rules.lead_score(f).alias("score"))


@query(
    "FLT5_blockers_by_search",
    with_views(f"""SELECT company_id, CASE WHEN {_has(_TEXT, R.HISTORICAL)} THEN 'historical_or_person' WHEN {_MEDIA} THEN 'media_publishing' WHEN conflict_ THEN 'conflicting_industry'
 WHEN target = 'technology' AND {_has(_TEXT, R.NO_SAAS)} THEN 'non_saas_tech' WHEN {_BLOCK} IS NOT NULL THEN 'non_commercial_org' WHEN {_INVESTOR} THEN 'investor_accelerator' END AS reason
 FROM companies JOIN (SELECT company_id, target, conflict AS conflict_ FROM ({_JUDGED})) USING (company_id)"""),
)
def blockers(spark, sf_dir):
    """The first reason against a company for its own search."""
    rows = rules.with_industry_match(found_companies(spark, sf_dir), C("target")).withColumn("text", rules.company_text())
    t = C("text")
    reason = (
        F.when(R.has(t, R.HISTORICAL), "historical_or_person")
        .when(R.is_media(t, C("domain")), "media_publishing")
        .when(C("m.conflict"), "conflicting_industry")
        .when((C("target") == "technology") & R.has(t, R.NO_SAAS), "non_saas_tech")
        .when(R.organisation_block(t, C("domain")).isNotNull(), "non_commercial_org")
        .when(R.is_investor(t, C("name"), C("domain")), "investor_accelerator")
    )
    return rows.select("company_id", reason.alias("reason"))


_NAMES = [
    ("Jane Doe", True), ("Dr. Jane Doe", True), ("Jane van Doe", True), ("Our Mission", False), ("Your Trusted Partner", False), ("Jo", False), ("Acme Solutions", False), ("jane doe", True), ("Jane 2 Doe", False), ("Privacy Policy", False),
    ("Digital Transformation Partner Services", False), ("Mary-Jane O’Neil", True), ("A B C D E", False), ("", False), (None, False), ("Sales Team", False), ("Contact Us", False),
]
case_query("FLT19_plausible_names", {"name": [n for n, _ in _NAMES]}, lambda df: {"plausible": R.plausible_name(C("name"))}, {"plausible": [p for _, p in _NAMES]})

_STATES = [("valid@acme.example", "valid"), ("invalid.1@acme.example", "invalid"), ("will-bounce@acme.example", "invalid"), ("risky@acme.example", "risky"), ("catchall-x@acme.example", "risky"), ("a@catchall.acme.example", "risky"), ("disposable@acme.example", "invalid"), ("unknown@acme.example", "unknown"), ("no address", "invalid"), ("@acme.example", "invalid")]


case_query("CLS9_mock_verifier", {"email": [e for e, _ in _STATES]}, lambda df: {"status": R.mock_status(C("email"))}, {"status": [s for _, s in _STATES]})

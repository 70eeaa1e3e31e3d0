"""The full sorts: every row with its rank, where the queries of the same number in the other modules give the first rows only.

Ties end in an identifier, where the sort that is followed keeps the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import countries, rules, titles
from ..operators import relational as R
from ..registry import SQL, query
from ..sources import model
from ..sources.model import with_views
from .functions import _REL, C
from .matching import _FIT, _RANK, fit
from .scores import soft_relevance


def _rank_sql(columns: str, rows: str, order: str) -> str:
    return with_views(f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rank FROM {rows}")


@query("SRT1_company_rank_all", _rank_sql("company_id, fit, confidence", f"({_FIT}) JOIN companies USING (company_id)", "fit DESC, coalesce(confidence, 0) DESC, company_id"))
def company_rank(spark, sf_dir):
    return R.ranked(fit(spark, sf_dir).select("company_id", "fit", "confidence"), [-C("fit"), -F.coalesce("confidence", F.lit(0)), C("company_id")])


_TARGET = "NATION_3"
#: Countries said of a seed that are not the target's.
_ELSEWHERE = r"\(united states\)|, united states\b|\(u\.s\.\)|\(india\)|, india\b|\bindia\)"
_AT_HOME = "(contains(lower(country), 'nation_3') OR contains('nation_3', lower(country)) OR coalesce(contains(lower(domain), 'nation_3'), false))"
_SEEDS = f"""(SELECT company_id, relevant AND NOT away AS relevant, CASE WHEN relevant THEN fit ELSE 0 END + 0.25::DOUBLE * coalesce(confidence, 0) + CASE company_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 0 END
 + CASE WHEN coalesce(trim(country), '') <> '' AND {_AT_HOME} THEN 30 ELSE 0 END - CASE WHEN away THEN 100 ELSE 0 END AS score
 FROM (SELECT *, reason IS NULL AS relevant, (coalesce(trim(country), '') <> '' AND NOT {_AT_HOME}) OR regexp_matches(lower(name || ' ' || coalesce(description, '')), '{_ELSEWHERE}') AS away
 FROM companies JOIN (SELECT company_id, fit FROM ({_FIT})) USING (company_id) JOIN ({SQL["FLT6_soft_relevance"]}) USING (company_id)))"""


@query("SRT2_seed_rank_all", _rank_sql("company_id, relevant, score", _SEEDS, "relevant DESC, score DESC, company_id"))
def seed_rank(spark, sf_dir):
    """Relevant ones (FLT6) of the target's country first, then the score; the fit (SCO4) counts for relevant ones only."""
    there = F.coalesce(F.trim("country") != "", F.lit(False))
    home = countries.matches(C("country"), _TARGET, C("domain"), F.lit(""))
    said = F.lower(F.concat("name", F.lit(" "), F.coalesce("description", F.lit("")))).rlike(_ELSEWHERE)
    seeds = model.companies(spark, sf_dir).select("company_id", "confidence", (there & home).alias("home"), ((there & ~home) | said).alias("away"))
    seeds = seeds.join(fit(spark, sf_dir).select("company_id", "fit"), "company_id").join(soft_relevance(spark, sf_dir).select("company_id", C("reason").isNull().alias("fits")), "company_id")
    source = F.when(C("company_id") % 3 == 0, 8).when(C("company_id") % 3 == 1, 4).otherwise(0)
    score = F.when(C("fits"), C("fit")).otherwise(0) + 0.25 * F.coalesce("confidence", F.lit(0)) + source + F.when(C("home"), 30).otherwise(0) - F.when(C("away"), 100).otherwise(0)
    rows = seeds.select("company_id", (C("fits") & ~C("away")).alias("relevant"), score.alias("score"))
    return R.ranked(rows, [~C("relevant"), -C("score"), C("company_id")])


@query("SRT3_contact_rank_all", _rank_sql("contact_id, full_name, confidence", "contacts", f"coalesce(confidence, {_REL}) DESC, full_name, contact_id"))
def contact_rank(spark, sf_dir):
    rows = model.contacts(spark, sf_dir).select("contact_id", "full_name", "confidence", F.coalesce("confidence", rules.title_relevance(C("title"))).alias("score"))
    return R.ranked(rows, [-C("score"), C("full_name"), C("contact_id")]).drop("score")


@query("SRT4_decision_rank_all", _rank_sql("contact_id, full_name, priority", f"(SELECT *, {_RANK} AS priority FROM contacts)", "priority DESC, full_name, contact_id"))
def decision_rank(spark, sf_dir):
    rows = model.contacts(spark, sf_dir).select("contact_id", "full_name", titles.decision_rank(C("title")).alias("priority"))
    return R.ranked(rows, [-C("priority"), C("full_name"), C("contact_id")])


@query("SRT6_listing_rank_all", _rank_sql("company_id, name, confidence", "companies", "confidence DESC, name, company_id"))
def listing_rank(spark, sf_dir):
    return R.ranked(model.companies(spark, sf_dir).select("company_id", "name", "confidence"), [-C("confidence"), C("name"), C("company_id")])


@query("SRT8_ui_sorts_all", _rank_sql("company_id, name", "companies", "name, company_id"))
def ui_sorts(spark, sf_dir):
    return R.ranked(model.companies(spark, sf_dir).select("company_id", "name"), [C("name"), C("company_id")])


@query("SRT10_searches_by_update_all", _rank_sql("search_id, name", "searches", "updated_ord DESC NULLS FIRST, search_id"))
def searches_by_update(spark, sf_dir):
    rows = model.searches(spark, sf_dir).select("search_id", "name", "updated_ord")
    return R.ranked(rows, [-C("updated_ord"), C("search_id")]).drop("updated_ord")

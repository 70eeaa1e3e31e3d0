"""Queries over names, companies and titles, on stated cases and on the model's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import people
from ..registry import query
from ..sources import model
from ..sources.cases import case_query
from ..sources.model import with_views

C = F.col

_NAMES = [
    ("Jane Doe", "jane  doe"), ("Jane Q. Doe", "Jane Doe"), ("Jane", "Jane Doe"), ("Jane Doe", "Jane"), ("Jane", "Jane"), ("Jane Doe", "John Doe"),
    ("Dr. Jane Doe", "Jane Doe"), ("O'Neil, Pat", "ONeil Pat"), ("", "Jane"), (None, None), ("Anna Maria Berg", "Anna Berg"), ("Doe Jane", "Jane Doe"), ("J. Doe", "J Doe"),
]
case_query(
    "JN12_same_person",
    {"a": [x for x, _ in _NAMES], "b": [y for _, y in _NAMES]},
    lambda df: {"same": people.same_person(C("a"), C("b")), "partial": people.is_partial_name(C("a")), "upgraded": people.upgraded_name(F.coalesce(C("a"), F.lit("")), C("b"))},
    {
        "same": [True, True, True, True, True, False, False, True, False, False, True, False, True],
        "partial": [False, False, True, False, True, False, False, False, False, False, False, False, True],
        "upgraded": ["Jane Doe", "Jane Q. Doe", "Jane Doe", "Jane Doe", "Jane", "Jane Doe", "Dr. Jane Doe", "O'Neil, Pat", "", "", "Anna Maria Berg", "Doe Jane", "J. Doe"],
    },
)


def _listed(spark, sf_dir):
    """People of a directory: full names, names with a middle word, and first names alone, by turns."""
    rows = model.contacts(spark, sf_dir).select(C("contact_id").alias("id"), "company_id", "full_name")
    words = F.split("full_name", " ")
    name = F.when(C("id") % 3 == 0, C("full_name")).when(C("id") % 3 == 1, F.concat(F.get(words, F.lit(0)), F.lit(" Middle "), F.try_element_at(words, F.lit(-1)))).otherwise(F.get(words, F.lit(0)))
    return rows.withColumn("full_name", name)


_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[.,'']', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


@query(
    "JN12_name_match",
    with_views(f"""WITH a AS (SELECT company_id AS g, contact_id AS left_id, full_name AS left_name, {_WORDS.format("full_name")} AS w FROM contacts),
 b AS (SELECT company_id AS g, contact_id AS right_id, CASE contact_id % 3 WHEN 0 THEN full_name WHEN 1 THEN string_split(full_name, ' ')[1] || ' Middle ' || string_split(full_name, ' ')[-1] ELSE string_split(full_name, ' ')[1] END AS right_name FROM contacts),
 c AS (SELECT *, {_WORDS.format("right_name")} AS v FROM b)
 SELECT a.g, left_id, left_name, right_id, right_name FROM a JOIN c USING (g)
 WHERE lower(left_name) = lower(right_name) OR (w[1] = v[1] AND ((len(w) > 1 AND len(v) > 1 AND w[-1] = v[-1]) OR least(len(w), len(v)) = 1 AND greatest(len(w), len(v)) > 1))"""),
)
def name_match(spark, sf_dir):
    people_ = model.contacts(spark, sf_dir).select(C("contact_id").alias("id"), "company_id", "full_name")
    return people.match_people(people_, _listed(spark, sf_dir), "company_id")


_COMPANIES = [("Acme Inc.", "ACME"), ("Acme Holdings plc", "Acme Group"), ("Northwind Traders Ltd", "Northwind"), ("IBM", "IBMX"), ("Inc", "Acme"), ("Blue Sky, LLC", "Red Sky"), ("The Big Data Company", "Big Data"), ("A.B. Co.", "A B")]
case_query(
    "STR16_same_company",
    {"a": [x for x, _ in _COMPANIES], "b": [y for _, y in _COMPANIES]},
    lambda df: {"bare": people.without_legal_ending(C("a")), "same": people.same_company(C("a"), C("b")), "words": F.array_join(people.company_words(C("a")), "|")},
    {
        "bare": ["Acme", "Acme", "Northwind Traders", "IBM", "", "Blue Sky", "The Big Data", "A B"],
        "same": [True, True, True, False, False, False, True, True],
        "words": ["acme", "acme", "northwind|traders", "ibm", "", "blue|sky", "big|data", ""],
    },
)

_AFFILIATIONS = [  # title, bio, source, on the site, leadership page, reason
    ("Chief Executive Officer", None, "website_team", True, True, None),
    ("Former CEO at Acme Robotics", None, "website_team", True, True, "former_employee"),
    ("Jane Doe - CEO - Globex", None, "website_team", True, False, "employed_at_other_company"),
    ("CTO", "Leads all of our engineering", "website_team", True, False, None),
    ("CTO", "She also works at Globex", "website_team", True, False, "no_company_affiliation_on_page"),
    ("Engineer", "Engineer with Acme Robotics", "website_team", False, False, "no_current_employment"),
    ("Founder", "Started Acme Robotics in a garage", "domain_search", False, False, None),
    ("Designer", "Nothing to see", "domain_search", False, False, "no_company_affiliation_on_page"),
    ("Designer at Globex", "Nothing to see", "website_team", False, False, "title_other_company"),
    (None, None, "linkedin_search", False, False, "no_affiliation_text"),
    ("Jane Doe - CEO - Acme Robotics | LinkedIn", None, "linkedin_search", False, False, None),
    ("Jane Doe - CEO - Globex | LinkedIn", "Acme Robotics is a customer", "linkedin_search", False, False, "employed_at_other_company"),
    ("Jane Doe", "Writes about robots", "linkedin_search", False, False, "company_not_mentioned"),
    ("Jane Doe", "Previously with Acme Robotics", "linkedin_search", False, False, "former_employee"),
    ("Jane Doe", "Works at Globex, knows Acme Robotics", "linkedin_search", False, False, "employed_at_other_company"),
    ("Jane Doe", "Currently building Acme Robotics", "linkedin_search", False, False, None),
    ("Jane Doe", "A friend of Acme Robotics", "linkedin_search", False, False, "no_current_employment"),
    ("Director", "Acme Robotics, Main Street 1", "directory_listing", False, False, None),
    ("Director", "Globex, Main Street 1", "directory_listing", False, False, "listing_not_for_company"),
    ("Clerk", "Past clerk with acmerobotics.example", "directory_listing", False, False, "former_employee"),
    ("Clerk", "acmerobotics.example front desk", "directory_listing", False, False, "no_executive_on_listing"),
    ("Human", "Acme Robotics", "wikidata", False, False, None),
    ("Human", "Globex", "wikidata", False, False, "wikidata_company_mismatch"),
    (None, None, "wikidata", False, False, None),
    ("CEO", "Acme Robotics", "elsewhere", False, False, "unknown_source"),
]


def _affiliation(df):
    staged, matches, reason = people.affiliation(df)
    return {"_df": staged, "matches": matches, "reason": reason}


case_query(
    "FLT25_affiliation",
    {**{c: [r[i] for r in _AFFILIATIONS] for i, c in enumerate(("title", "bio", "source", "on_site", "leadership_page"))}, "company": ["Acme Robotics Inc."] * len(_AFFILIATIONS), "domain": ["www.acmerobotics.example"] * len(_AFFILIATIONS)},
    _affiliation,
    {"matches": [r[5] is None for r in _AFFILIATIONS], "reason": [r[5] for r in _AFFILIATIONS]},
)

_TITLES = [  # title, an executive's, near to a VP Engineering
    ("Chief People Officer", True, False), ("Office Manager", False, False), ("Finance Manager", True, False), ("Board Member", False, False), ("Software Engineer", False, False),
    ("VP of Software Engineering", True, True), ("CTO", True, True), ("Head of Platform", True, True), ("Product Director", True, True), ("Director of Software", True, True),
    ("Engineering Manager", True, True), ("Vice President of Data", True, True), ("Partner", True, False), ("Team Member", False, False), ("Chair", False, False), ("Former CEO", False, False), ("VP Product", True, True), (None, False, False),
]
case_query(
    "FLT16_fallback_titles",
    {"title": [t for t, _, _ in _TITLES]},
    lambda df: {"fallback": people.fallback_title(C("title")), "related": people.related_title(C("title"), F.array(F.lit("VP  Engineering"))), "unrelated": people.related_title(C("title"), F.array(F.lit("CFO")))},
    {"fallback": [f for _, f, _ in _TITLES], "related": [r for _, _, r in _TITLES], "unrelated": [False] * len(_TITLES)},
)

_TITLE_TEXTS = [
    ("Jane Doe, senior vice president of engineering. View bio", "Senior Vice President of Engineering"),
    ("executive vice president and treasurer | more", "Executive Vice President and Treasurer"),
    ("vp of sales, emea", "VP of Sales, Emea"),
    ("our chief commercial officer joined", "Chief Commercial Officer"),
    ("Director of it, since 2001", "Director of IT"),
    ("she is head of growth.", "Head of Growth"),
    ("a co-founder of the firm", "Co-founder"),
    ("Jane, cto", "CTO"),
    ("vice president", "Vice President"),
    ("Read more", None),
    ("just a person", None),
    (None, None),
]
case_query("STR17_title_in_text", {"text": [t for t, _ in _TITLE_TEXTS]}, lambda df: {"title": people.title_in_text(C("text"))}, {"title": [t for _, t in _TITLE_TEXTS]})

"""Whether two names are one person's or one company's, and whether a text places a person at a company."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import titles
from .text import collapse, has

# fixed values: endings of a company's legal name, and words that tell no company from another
LEGAL_ENDING = r"\b(incorporated|inc\.?|llc|l\.l\.c\.?|ltd\.?|limited|corp\.?|corporation|company|co\.?|group|holdings|plc)\b"
COMMON_WORDS = ["the", "and", "for", "usa", "uk", "inc", "llc", "ltd", "corp", "company", "group"]

# fixed values: what says that a role is over, and what a current role is called
FORMER = r"\b(?:former(?:ly)?|ex[-\s]|previous(?:ly)?|past)\b[^|]{0,48}\b(?:at|@|with)\b"
CURRENT = r"\b(?:ceo|cto|cfo|coo|cmo|cpo|chro|founder|co[-\s]?founder|president|director|owner|manager|vp|vice president|editor in chief|editor-in-chief|chief\s+[\w\s]{0,24}\s+officer|head of|vd|grundare|verkställande|styrelse|managing director|general manager|board of directors)\b"

# fixed values: titles that count when the wanted one is missing, and managers who lead an operation, not a company
FALLBACK_TITLES = ["ceo", "cfo", "coo", "cto", "cmo", "owner", "director", "founder", "co-founder", "president", "vice president", "vp", "chairman", "partner", "head of"]
SITE_TITLES = ["CEO", "CTO", "CFO", "COO", "CMO", "CPO", "CHRO", "Founder", "Co-Founder", "President", "Vice President", "VP"]
OPERATIONAL_MANAGERS = r"\b(workshop|office|project|program|account|store|warehouse|shift|floor|area|department|hr|human resources|facilities|maintenance|production|plant|site|field|customer|client|community|content|social media|digital marketing|brand|events|logistics|supply chain|inventory|quality|safety|security)\s+manager\b"
CHIEF_OFFICER = r"\bchief\s+[\w\s]{0,24}\s+officer\b"

# fixed values: roles near to a VP Engineering
NEAR_VP_ENGINEERING = [
    r"\b(cto|chief technology officer|chief technical officer|chief information officer)\b",
    r"\bhead of (engineering|technology|tech|software|it|digital|product|platform)\b",
    r"\b(engineering|technology|software|it|digital|platform|product)\s+director\b",
    r"\bdirector of (engineering|technology|software|it|digital|platform)\b",
    r"\bengineering manager\b",
    r"\bvp\b[^|]{0,30}\b(product|platform)\b",
]

# fixed values: titles that a text can hold, in the order in which they are looked for, and whether a loose end is cut
TEXT_TITLES = [
    (r"\b((?:senior |executive )?vice president(?:,|\s+of|\s+—|\s+-|\s+–)\s*(?:engineering|technology|tech|software|it|digital|platform|data|product|operations|sales|marketing|finance|commercial|customer success|human resources|hr)[^|.\n]{0,24})", True),
    (r"\b((?:senior |executive )?vice president[^|.\n]{0,48})", True),
    (r"\b(vp\s+(?:of\s+)?(?:engineering|technology|tech|software|it|digital|platform|product|sales|marketing|operations|finance|hr|human resources)[^|.\n]{0,24})", True),
    (r"\b(chief\s+(?:general\s+|privacy\s+|commercial\s+|technology\s+|technical\s+|information\s+|[\w]+\s+){0,3}officer)\b", False),
    (r"\b(managing director|executive director|general manager|engineering director|technology director|director of (?:engineering|technology|software|it|digital|platform|product|sales|marketing|operations|finance))\b", False),
    (r"\b(head of (?:engineering|technology|tech|software|it|digital|platform|product|growth|sales|marketing|operations|finance|people|hr|human resources)[^|.\n]{0,24})", True),
    (r"\b(co[- ]?founder|cofounder|founder|president|chairman|chairperson|chairwoman|owner|partner)\b", False),
    (r"\b(ceo|cto|cfo|coo|cmo|cpo|chro)\b", False),
]
SMALL_WORDS = ["of", "and", "the", "at", "for"]
SHORT_TITLES = r"(?i)^(vp|svp|evp|ceo|cto|cfo|coo|cmo|cpo|chro|it|hr)$"


def person_key(name: Column) -> Column:
    """Lower case, single spaces, no points, commas and apostrophes; '' for nobody."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[.,']", ""))


def name_words(name: Column) -> Column:
    return F.filter(F.split(person_key(name), " "), lambda w: F.length(w) > 1)


def is_partial_name(name: Column) -> Column:
    return F.size(name_words(name)) == 1


def upgraded_name(partial: Column, resolved: Column) -> Column:
    """The resolved name where the other is only its first word."""
    own, full = name_words(partial), name_words(resolved)
    fits = (F.size(own) == 1) & (F.size(full) >= 2) & (F.get(own, F.lit(0)) == F.get(full, F.lit(0)))
    return F.when(F.coalesce(fits, F.lit(False)), F.trim(resolved)).otherwise(F.trim(partial))


def same_person(a: Column, b: Column) -> Column:
    """Equal names, equal first and last words, or one word that is the other's first.  Words of one name that stand in
    order in the other, ends included, are a case of the second."""
    x, y = name_words(a), name_words(b)
    first = F.get(x, F.lit(0)) == F.get(y, F.lit(0))
    last = F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))
    single = (F.least(F.size(x), F.size(y)) == 1) & (F.greatest(F.size(x), F.size(y)) >= 2) & first
    several = (F.size(x) >= 2) & (F.size(y) >= 2) & first & last
    there = (person_key(a) != "") & (person_key(b) != "")
    return F.coalesce(there & ((person_key(a) == person_key(b)) | single | several), F.lit(False))


def match_people(left: DataFrame, right: DataFrame, group: str, name: str = "full_name") -> DataFrame:
    """left and right rows of one group whose names are one person's: left_name, right_name and both sides' id.

    The rule is three equalities, so three hash joins without a residual: the whole name; first and last word; and a
    single word against a first word.  No block of a common first name meets itself.  Both have columns group, name, id.
    """

    def keyed(df: DataFrame, side: str) -> DataFrame:
        words = name_words(F.col(name))
        rows = df.select(F.col(group).alias("g"), F.col("id").alias(f"{side}_id"), F.col(name).alias(f"{side}_name"), person_key(F.col(name)).alias("whole"), F.size(words).alias("n"), F.get(words, F.lit(0)).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"))
        return rows.where("whole != ''")

    a, b = keyed(left, "left"), keyed(right, "right")
    out = ["g", "left_id", "left_name", "right_id", "right_name"]
    whole = a.join(b, ["g", "whole"]).select(out)
    ends = a.where("n >= 2").join(b.where("n >= 2"), ["g", "first", "last"]).select(out)
    one = a.where("n = 1").join(b.where("n >= 2"), ["g", "first"]).select(out)
    other = a.where("n >= 2").join(b.where("n = 1"), ["g", "first"]).select(out)
    return whole.union(ends).union(one).union(other).distinct()


def without_legal_ending(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, f"(?i){LEGAL_ENDING}", ""), "[,.']", " "), r"\s+", " "))


def company_words(name: Column) -> Column:
    parts = F.transform(F.split(F.lower(without_legal_ending(name)), r"[\s,.\-]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON_WORDS))


def same_company(a: Column, b: Column) -> Column:
    x, y = F.lower(without_legal_ending(F.trim(a))), F.lower(without_legal_ending(F.trim(b)))
    part = (F.length(x) >= 4) & (F.length(y) >= 4) & (x.contains(y) | y.contains(x))
    return F.coalesce((x != "") & (y != "") & ((x == y) | part), F.lit(False))


@dataclass
class Company:
    """What a text is searched for: columns that staged_company has made once a row."""

    name: Column
    words: Column
    domain: Column


def staged_company(df: DataFrame, name: str = "company", domain: str = "domain") -> tuple[DataFrame, Company]:
    host = F.lower(F.regexp_replace(F.coalesce(F.col(domain), F.lit("")), r"^www\.", ""))
    df = df.withColumns({"_name": F.lower(without_legal_ending(F.trim(F.col(name)))), "_words": company_words(F.col(name)), "_host": host})
    return df, Company(F.col("_name"), F.col("_words"), F.col("_host"))


def mentions(text: Column, company: Company) -> Column:
    """By its name, by a part of it as a whole text, by all its long words or its only word, or by its domain."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    compact = F.regexp_replace(low, "[^a-z0-9]", "")
    bare = F.lower(without_legal_ending(F.trim(F.coalesce(text, F.lit("")))))
    name, words, host = company.name, company.words, company.domain
    long_words = F.filter(words, lambda w: F.length(w) >= 4)
    root = F.substring_index(host, ".", 1)
    return (low != "") & (
        ((F.length(name) >= 2) & low.contains(name))
        | ((bare != "") & (name != "") & ((bare == name) | ((F.length(bare) >= 4) & (F.length(name) >= 4) & (bare.contains(name) | name.contains(bare)))))
        | ((F.size(long_words) > 0) & F.forall(long_words, lambda w: compact.contains(w)))
        | ((F.size(words) == 1) & F.coalesce(compact.contains(F.get(words, F.lit(0))), F.lit(False)))
        | ((host != "") & (low.contains(host) | ((F.length(root) >= 3) & compact.contains(root))))
    )


def employers(text: Column) -> Column:
    """What stands after at or @, up to a mark or a dash."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:at|@)\s+([^|,.;\n]+)"), F.lit(1)), lambda t: F.trim(t))
    return F.transform(F.filter(found, lambda t: t != ""), lambda t: F.trim(F.get(F.split(t, r"\s*[-–|]\s*"), F.lit(0))))


def segments(title: Column) -> Column:
    """Parts of a profile's headline behind the first: dashes, bars, points and commas part them."""
    bare = F.trim(F.regexp_replace(title, r"(?i)\s*\|\s*LinkedIn.*$", ""))
    parts = F.flatten(F.transform(F.split(bare, r"\s*[-–|·]\s*"), lambda s: F.split(s, r"\s*,\s*")))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.slice(parts, 2, 1000)


def affiliation(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(staged rows, matches, reason) of title, bio, source, on_site, leadership_page, company, domain.

    Each test is a column of its own, so that the four rules of a source share them.
    """
    df, company = staged_company(df)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({"_title": F.trim(text("title")), "_text": F.trim(F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("bio"), F.lit(""))))})
    df = df.withColumns({"_parts": segments(F.col("_title")), "_text_parts": segments(F.col("_text")), "_employers": employers(F.col("_text"))})
    letters = lambda p: p.rlike("[a-zA-Z]")
    apart = lambda p: ~mentions(p, company)
    bare_role = lambda p: (F.length(p) <= 28) & has(p, CURRENT) & ~has(p, r"\b(at|@)\b")
    df = df.withColumns(
        {
            "_mentioned": mentions(F.col("_text"), company),
            "_former": has(F.col("_text"), FORMER) & mentions(F.col("_text"), company),
            "_elsewhere": F.exists("_parts", lambda p: (F.length(p) >= 4) & letters(p) & apart(p)),
            "_employed_elsewhere": F.exists("_employers", lambda e: (F.length(e) >= 3) & apart(e)) | F.exists("_text_parts", lambda p: (F.length(p) >= 4) & letters(p) & ~bare_role(p) & apart(p)),
            "_headline_here": F.exists("_parts", lambda p: mentions(p, company)),
            "_role_here": has(F.col("_text"), CURRENT) & mentions(F.col("_text"), company) & (F.exists("_employers", lambda e: mentions(e, company)) | F.exists("_text_parts", lambda p: mentions(p, company))),
            "_role": has(F.col("_title"), CURRENT),
        }
    )
    c = F.col
    on_site, leads = F.coalesce(c("on_site"), F.lit(False)), F.coalesce(c("leadership_page"), F.lit(False))
    other_title = (text("bio") != "") & ~mentions(text("bio"), company) & has(text("title"), r"\bat\s+[^|,.\-]+") & ~mentions(text("title"), company)
    of_site = (
        F.when(c("_former"), "former_employee")
        .when(c("_elsewhere"), "employed_at_other_company")
        .when((on_site & leads) | (on_site & c("_role") & ~c("_employed_elsewhere")), "")
        .when(c("_mentioned") & (c("_role_here") | c("_role")), "")
        .when(c("_mentioned"), "no_current_employment")
        .when(other_title, "title_other_company")
        .otherwise("no_company_affiliation_on_page")
    )
    of_profile = (
        F.when(c("_text") == "", "no_affiliation_text")
        .when(c("_elsewhere"), "employed_at_other_company")
        .when(~c("_mentioned"), "company_not_mentioned")
        .when(c("_former"), "former_employee")
        .when(c("_employed_elsewhere"), "employed_at_other_company")
        .when(c("_headline_here") | c("_role_here") | has(c("_text"), r"\bcurrent(?:ly)?\b"), "")
        .otherwise("no_current_employment")
    )
    of_listing = (
        F.when(~c("_mentioned"), "listing_not_for_company").when(c("_former"), "former_employee").when(c("_role") | c("_role_here"), "").otherwise("no_executive_on_listing")
    )
    reason = (
        F.when(c("source") == "wikidata", F.when((c("_text") != "") & ~c("_mentioned"), "wikidata_company_mismatch").otherwise(""))
        .when(c("source").isin("website_team", "domain_search"), of_site)
        .when(c("source") == "linkedin_search", of_profile)
        .when(c("source") == "directory_listing", of_listing)
        .otherwise("unknown_source")
    )
    df = df.withColumn("_reason", reason)
    return df, c("_reason") == "", F.nullif(c("_reason"), F.lit(""))


def _decides(clean: Column) -> Column:
    barred = has(clean, titles.NO_DECISION) | (has(clean, titles.NO_EXECUTIVE) & ~has(clean, titles.STILL_EXECUTIVE))
    return ~clean.isin(titles.UNKNOWN_TITLES) & ~barred


def fallback_title(title: Column) -> Column:
    """An executive's title, whatever was asked for."""
    clean = collapse(F.coalesce(title, F.lit("")))
    words = [t for t in FALLBACK_TITLES if " " not in t]
    held = has(clean, CHIEF_OFFICER) | has(clean, r"\b(" + "|".join(words).replace("-", r"\-") + r")\b")
    for phrase in (t for t in FALLBACK_TITLES if " " in t):
        held = held | clean.contains(phrase)
    held = held | (has(clean, r"\bmanager\b") & ~has(clean, OPERATIONAL_MANAGERS))
    return _decides(clean) & (held | titles.title_matches(title, titles.DEFAULT_TITLES) | titles.title_matches(title, SITE_TITLES))


def related_title(title: Column, wanted: Column) -> Column:
    """Near to a wanted VP Engineering; nothing is near to other titles.  wanted: array of titles."""
    clean = collapse(F.coalesce(title, F.lit("")))
    asked = F.exists(F.transform(wanted, collapse), lambda w: w.contains("vp engineering") | w.contains("vice president engineering") | (w == "vp eng") | w.rlike(r"\bvp\b.*\bengineering\b"))
    near = has(clean, titles.VP_ENGINEERING)
    for pattern in NEAR_VP_ENGINEERING:
        near = near | has(clean, pattern)
    return _decides(clean) & asked & near


def title_case(text: Column) -> Column:
    def word(w: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(SMALL_WORDS), low).when(w.rlike(SHORT_TITLES), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, 2, 1000)))

    cased = F.array_join(F.transform(F.split(text, r"\s+"), word), " ")
    for short in ("VP", "SVP", "EVP"):
        cased = F.regexp_replace(cased, rf"\b{short.title()}\b", short)
    return cased


def title_in_text(text: Column) -> Column:
    """The first executive title of at least three and at most eighty characters that a text holds."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(view bio|read more)\b", " "), r"\s+", " "))
    found = []
    for pattern, loose in TEXT_TITLES:
        hit = F.regexp_extract(clean, f"(?i){pattern}", 1)
        hit = title_case(F.trim(F.regexp_replace(hit, r"[,.|–\-]\s*$", "") if loose else hit))
        hit = F.upper(hit) if pattern == TEXT_TITLES[-1][0] else hit
        found.append(F.when(F.length(hit).between(3, 80) & ~collapse(hit).isin(titles.UNKNOWN_TITLES), hit))
    return F.coalesce(*found)

"""What company pages and answers say: addresses, titles, JSON-LD.  The elements of a page are in operators/html_nodes.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .relevance import plausible_name
from .text import has

# fixed values: words of a title on a page, and addresses of pages that list people or news
TITLE_WORDS = [
    "ceo", "cto", "cfo", "coo", "founder", "co-founder", "cofounder", "president", "director", "managing director", "executive", "vp", "vice president", "head of", "manager", "lead", "chief", "chairman", "chairperson",
    "deputy", "partner", "owner", "vd", "grundare", "verkställande", "styrelse", "ordförande", "ekonomichef", "marknadschef", "sales director", "commercial",
]
PEOPLE_PATHS = r"/(team|people|leadership|management|board|directors|executive|staff|about|department|key-management|om-oss|ledning|vara-team|medarbetare|organisation|org)(/|$)|-(team|management|leadership|staff)(/|$)"
PRESS_PATHS = r"/(awards|news|press|media|blog|events|speakers|announcements|insights|stories)/"
EXECUTIVE = r"\b(ceo|cto|cfo|coo|cmo|cpo|founder|co[-\s]?founder|president|director|owner|manager|vp|vice president|chief|head of|officer|executive)\b"
NO_TITLE_LINES = r"^(read more|contact|email|phone|linkedin)$"

ORGANISATION = r"(?i)^(Organization|LocalBusiness|Corporation|ProfessionalService)$"

# fixed values: a name and a title side by side in a line, behind "said", and in running text
NAME_AND_TITLE = r"^([A-Z][A-Za-z.'’-]+(?:\s+[A-Z]\.?[A-Za-z.'’-]+){0,4})\s*,\s*(.+)$"
SAID = r"(?i)\bsaid\s+([A-Z][A-Za-z.'’-]+(?:\s+[A-Z]\.?[A-Za-z.'’-]+){0,4}),\s*([^\".]+?)(?:\.|\s+\"|$)"
IN_TEXT = r"\b([A-Z][a-z]+(?:\s+[A-Z]\.?[a-z]+){1,3}),\s*(Vice President[^.:]{0,60}|President[^.:]{0,40}|Chief [A-Za-z ]{3,40} Officer|CEO|CTO|CFO|COO|Sales Director|Managing Director|Director of [A-Za-z ]{2,40})\b"

PERSON = "struct<rank:int,name:string,title:string,email:string,profile:string>"


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)), F.lit(""))


def is_title(line: Column) -> Column:
    return has(line, "(?:" + "|".join(TITLE_WORDS) + ")")


def lists_people(url: Column) -> Column:
    return has(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:https?://)?[^/?#]+([^?#]*)", 1), PEOPLE_PATHS)


def tells_news(url: Column) -> Column:
    return has(F.concat(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:https?://)?[^/?#]+([^?#]*)", 1), F.lit("/")), PRESS_PATHS)


def json_ld(html: Column) -> Column:
    """Every JSON-LD node as JSON text: of a list its items, of an object itself and its graph; broken ones are left out."""
    raw = F.transform(all_of(html, r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), lambda x: F.trim(x))
    none = F.array().cast("array<string>")
    nodes = lambda x: F.coalesce(F.from_json(x, "array<string>"), none)
    each = F.transform(raw, lambda x: F.when(x.startswith("["), nodes(x)).otherwise(F.concat(F.array(x), nodes(F.get_json_object(x, "$['@graph']")))))
    return F.filter(F.flatten(each), lambda x: F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")) != "")


def _text_at(node: Column, path: str) -> Column:
    """A text, or the name of an object, at a path."""
    value = F.get_json_object(node, path)
    return F.nullif(F.trim(F.when(value.startswith("{"), F.get_json_object(node, path + ".name")).otherwise(value)), F.lit(""))


def organisation(html: Column) -> Column:
    """The first JSON-LD organisation with any field: struct(name, website, phone, location, city, description)."""
    address = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")

    def types(node: Column) -> Column:
        kind = F.get_json_object(node, "$['@type']")
        return F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))

    def fields(node: Column) -> Column:
        whole = F.get_json_object(node, "$.address")
        parts = F.concat_ws(", ", *[F.nullif(F.trim(F.get_json_object(node, f"$.address.{p}")), F.lit("")) for p in address])
        location = F.nullif(F.trim(F.when(whole.startswith("{"), parts).otherwise(whole)), F.lit(""))
        return F.struct(_text_at(node, "$.name").alias("name"), _text_at(node, "$.url").alias("website"), _text_at(node, "$.telephone").alias("phone"), location.alias("location"), _text_at(node, "$.address.addressLocality").alias("city"), _text_at(node, "$.description").alias("description"))

    found = F.transform(F.filter(json_ld(html), lambda n: F.exists(types(n), lambda t: t.rlike(ORGANISATION))), fields)
    return F.get(F.filter(found, lambda o: F.coalesce(o["name"], o["website"], o["phone"], o["location"], o["description"]).isNotNull()), F.lit(0))


def listing_completeness(name: Column, website: Column, phone: Column, location: Column, description: Column, links: Column) -> Column:
    there = lambda c, n: F.when(F.coalesce(c != "", F.lit(False)), n).otherwise(0)
    told = F.when(F.length(description) > 40, 20).otherwise(there(description, 8))
    return F.least(F.lit(100), 10 + F.when(F.length(F.trim(name)) >= 2, 10).otherwise(0) + there(website, 20) + there(phone, 15) + there(location, 15) + told + F.least(F.lit(15), links * 5))


def _person(rank: int, name: Column, title: Column, email: Column, profile: Column) -> Column:
    clean = F.lower(F.regexp_extract(F.coalesce(profile, F.lit("")), r"(?i)linkedin\.com/in/([a-z0-9_%-]+)", 1))
    address = F.when(clean != "", F.concat(F.lit("https://www.linkedin.com/in/"), clean))
    return F.struct(F.lit(rank).alias("rank"), name.alias("name"), F.coalesce(title, F.lit("Team Member")).alias("title"), email.alias("email"), address.alias("profile")).cast(PERSON)


def _first_of_each(people: Column, key) -> Column:
    keys = F.transform(people, key)
    return F.filter(people, lambda p, i: F.array_position(keys, key(p)) == i + 1)


def people_of_answer(answer: Column) -> Column:
    """The people of a model's answer: its first JSON list; the first of a name and title, twelve at most."""
    raw = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\[.*\]", 0)
    rows = F.coalesce(F.from_json(raw, "array<struct<fullName:string,name:string,title:string,jobTitle:string,email:string>>"), F.array().cast("array<struct<fullName:string,name:string,title:string,jobTitle:string,email:string>>"))
    nobody = F.lit(None).cast("string")
    people = F.transform(rows, lambda r: _person(1, F.trim(F.coalesce(r["fullName"], r["name"], F.lit(""))), F.trim(F.coalesce(r["title"], r["jobTitle"], F.lit("Team Member"))), F.nullif(F.trim(r["email"]), F.lit("")), nobody))
    people = F.filter(people, lambda p: F.length(p["name"]) >= 3)
    return F.slice(_first_of_each(people, lambda p: F.concat_ws("|", F.lower(p["name"]), F.lower(p["title"]))), 1, 12)


def as_text(people: Column) -> Column:
    return F.array_join(F.transform(people, lambda p: F.concat_ws("|", p["name"], p["title"], F.coalesce(p["email"], F.lit("-")), F.coalesce(p["profile"], F.lit("-")))), ";")

"""Mailboxes, profiles and what they say of a contact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has, is_placeholder

# fixed values: local parts of mailboxes that belong to no single person
SHARED_MAILBOXES = [
    "info", "contact", "hello", "hi", "support", "help", "sales", "marketing", "press", "media", "admin", "office", "team", "careers", "jobs", "hr", "billing", "accounts", "enquiries", "inquiries",
    "noreply", "no-reply", "donotreply", "webmaster", "postmaster", "abuse", "feedback", "customerservice", "customer.service", "ceo", "cfo", "cto", "coo", "cmo", "cpo", "chro", "president", "founder",
    "chairman", "chairperson", "director", "executive", "management", "corporate", "general", "reception", "enquiry", "inquiry", "ir", "investor", "investors", "partners", "partner", "relations",
]


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def is_shared(email: Column) -> Column:
    """A mailbox of a function; digits and marks in it don't count."""
    local = F.regexp_replace(local_part(email), "[._-]", "")
    return F.coalesce((local == "") | local.isin(SHARED_MAILBOXES) | F.regexp_replace(local, r"\d", "").isin(SHARED_MAILBOXES), F.lit(True))


def is_own(email: Column, name: Column) -> Column:
    """A mailbox that carries the person's name in one of the usual ways."""
    local = F.regexp_replace(local_part(email), "[._+-]", "")
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: F.length(w) > 1)
    first, last = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")
    initial = F.substring(first, 1, 1)
    ways = F.array(first, last, F.concat(first, last), F.concat(initial, last), F.when(last != "", F.concat(initial, F.substring(last, 1, 1))).otherwise(""))
    hit = F.exists(ways, lambda v: (F.length(v) >= 2) & (v == local)) | ((last != "") & local.contains(first) & local.contains(last))
    return F.coalesce((F.length(local) >= 2) & (first != "") & hit, F.lit(False))


def personal_email(email: Column, name: Column) -> Column:
    """The address if it is the person's own, lower-cased; else null."""
    clean = F.lower(F.trim(email))
    return F.when((clean != "") & ~is_placeholder(clean) & ~is_shared(clean) & is_own(clean, name), clean)


def public_email(email: Column) -> Column:
    """A mailbox of the firm will do, an example's won't."""
    clean = F.lower(F.trim(email))
    return F.when((clean != "") & ~is_placeholder(clean), clean)


def best_email(mailto: Column, candidates: Column, name: Column) -> Column:
    """The linked address if it is the person's own, else the first candidate that is."""
    own = F.filter(F.transform(candidates, lambda c: personal_email(c, name)), lambda c: c.isNotNull())
    return F.coalesce(personal_email(mailto, name), F.get(own, F.lit(0)))


def quality_tier(email: Column, name: Column, profile: Column) -> Column:
    """high: the person's own address; medium: a profile alone; low: the rest."""
    clean, linked = F.lower(F.trim(F.coalesce(email, F.lit("")))), F.trim(F.coalesce(profile, F.lit(""))) != ""
    of_mail = F.when(is_placeholder(clean), F.when(linked, "medium").otherwise("low")).when(personal_email(clean, name).isNotNull(), "high").otherwise("low")
    return F.when(clean != "", of_mail).when(linked, "medium").otherwise("low")


def contact_score(email: Column, found: Column, profile: Column, from_site: Column, shown: Column, detail: Column) -> Column:
    """0 to 100 of how a person can be reached; found: whether the address was found and not guessed; from_site: where
    the profile's link stood; shown: the address's display status; detail: the kind of contact."""
    mail, linked = F.trim(F.coalesce(email, F.lit(""))) != "", F.trim(F.coalesce(profile, F.lit(""))) != ""
    tier = quality_tier(email, F.lit(None).cast("string"), profile)
    shown, detail = F.coalesce(shown, F.lit("")), F.coalesce(detail, F.lit(""))
    of_mail = F.when(shown == "verified", 55).when(shown == "likely_valid", 40).when(mail & found, F.when(tier == "high", 45).when(tier == "low", 8).when(detail == "public_email", 12).otherwise(20)).otherwise(0)
    of_profile = F.when(linked, F.when((tier == "medium") & ~mail, 28).when(from_site, 22).otherwise(18)).otherwise(0)
    total = of_mail + of_profile
    return F.least(F.lit(100), F.when(detail == "contact_page_only", F.greatest(total, F.lit(15))).otherwise(total))


def profile_score(own_name: Column, in_text: Column, slug_fits: Column, title_fits: Column, role_in_text: Column, at_company: Column, company_in_text: Column) -> Column:
    """0 to 100 of how surely a found profile is the person's: name, address, title and company, the better test of each."""
    return F.least(
        F.lit(100),
        F.when(own_name, 35).when(in_text, 28).otherwise(0)
        + F.when(slug_fits, 22).when(in_text, 12).otherwise(0)
        + F.when(title_fits, 18).when(role_in_text, 10).otherwise(0)
        + F.when(at_company, 25).when(company_in_text, 12).otherwise(0),
    )


def titles_overlap(wanted: Column, found: Column) -> Column:
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    return F.coalesce(F.arrays_overlap(words(wanted), words(found)), F.lit(False))


def name_in_text(name: Column, text: Column) -> Column:
    """The whole name, or its first and last word side by side; dashes and bars of the text count as spaces."""
    from .people import name_words, person_key, same_person

    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[|\-–]", " "), r"\s+", " "))
    words = name_words(name)
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    alone = (F.size(words) == 1) & F.arrays_overlap(F.split(low, r"\W+"), F.array(first))
    ends = (F.size(words) >= 2) & low.contains(F.concat(first, F.lit(" "), last))
    return F.coalesce((low != "") & (person_key(name) != "") & (low.contains(person_key(name)) | alone | ends | same_person(name, text)), F.lit(False))


def slug_has_name(url: Column, name: Column) -> Column:
    """Whether a profile's address carries the first and the last word of the name."""
    from .people import name_words

    slug = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"linkedin\.com/in/([^/?#]+)", 1)
    words = F.transform(name_words(name), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.coalesce((slug != "") & (F.size(words) >= 2) & slug.contains(F.get(words, F.lit(0))) & slug.contains(F.try_element_at(words, F.lit(-1))), F.lit(False))


def has_role(text: Column, role: str) -> Column:
    return has(text, rf"\b{role}\b")

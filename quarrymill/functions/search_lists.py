"""Lists that a search carries, held against a company: keywords that must be there, and what is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import has, joined, normalize_domain


def _clean(words: Column) -> Column:
    return F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")


def keywords_match(text: Column, keywords: Column) -> Column:
    """All keywords, or a synonym of each, stand in the lower-cased text; of several health keywords one will do, and b2b is not
    asked for beside software."""
    known = F.create_map(*[x for k, words in fixed.KEYWORD_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    words = _clean(keywords)
    software = F.exists(words, lambda w: w.isin(fixed.SOFTWARE_KEYWORDS))
    words = F.when(software, F.array_remove(words, "b2b")).otherwise(words)
    there = lambda w: text.contains(w) | F.coalesce(F.exists(F.try_element_at(known, w), lambda s: text.contains(s)), F.lit(False))
    health = sorted({*fixed.KEYWORD_SYNONYMS["healthtech"], *fixed.KEYWORD_SYNONYMS["healthcare"]})
    together = (F.size(words) > 1) & F.forall(words, lambda w: has(w, fixed.HEALTH_CLUSTER) | w.isin(health))
    return F.when(together, F.exists(words, there)).otherwise(F.forall(words, there))


def excluded(name: Column, domain: Column, industry: Column, country: Column, domains: Column, industries: Column, keywords: Column, countries: Column) -> Column:
    """The domain is listed, or a listed word stands in the industry, the country, or in name and industry."""
    none = F.array().cast("array<string>")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    any_in = lambda words, said: F.exists(F.coalesce(words, none), lambda w: said.contains(F.lower(w)))
    listed = F.exists(F.coalesce(domains, none), lambda d: normalize_domain(d) == normalize_domain(domain))
    whole = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(industry, F.lit(""))))
    return F.coalesce(listed, F.lit(False)) | any_in(industries, low(industry)) | any_in(countries, low(country)) | any_in(keywords, whole)


def company_text(name: Column, domain: Column, description: Column, industry: Column) -> Column:
    return joined(name, domain, description, industry)

"""What a search asks the web: business models in its words, and the distinct queries that follow, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has, once

# fixed values: business models in their order: id, pattern, the first phrase that stands for it
MODELS = [
    ("saas", r"\b(saas|software as a service|subscription software|cloud software)\b", "B2B SaaS software company"),
    ("b2b", r"\b(b2b|business to business|enterprise|b2b software)\b", "B2B technology company"),
    ("b2c", r"\b(b2c|consumer|retail app|direct to consumer)\b", "consumer technology company"),
    ("marketplace", r"\b(marketplace|platform|two-sided|aggregator)\b", "online marketplace platform"),
    ("ai", r"\b(ai|artificial intelligence|machine learning|ml|llm|genai)\b", "AI software company"),
    ("agency", r"\b(agency|digital agency|creative agency|dev shop)\b", "technology agency"),
    ("consulting", r"\b(consulting|advisory|professional services)\b", "IT consulting firm"),
    ("ecommerce", r"\b(ecommerce|e-commerce|online store|shopify)\b", "e-commerce technology company"),
    ("fintech", r"\b(fintech|payments|banking|financial technology)\b", "fintech company"),
    ("healthtech", r"\b(healthtech|health tech|medtech|digital health)\b", "health technology company"),
]
GENERAL = ("general", "technology company")

# fixed values: phrases of industries, and what is asked in addition for shops and for health
INDUSTRY_PHRASES = {
    "technology": "software technology company", "saas": "B2B SaaS company", "healthcare": "healthcare technology company", "media & entertainment": "media entertainment company", "financial services": "fintech company",
    "logistics": "logistics technology company", "hospitality": "hospitality technology company", "cybersecurity": "cybersecurity company", "edtech": "education technology company", "e-commerce": "e-commerce company", "consulting": "technology consulting firm",
}
SHOP_QUERIES = ["e-commerce online store", "online retailer", "ecommerce company"]
HEALTH_QUERIES = ["digital health company", "health IT company", "health information technology", "medical technology company", "healthcare IT services"]
SMALL_HEALTH_QUERIES = ["healthcare software SMB", "small healthtech"]
SMALL, ENGINEERING_LEADS = 250, r"\b(cto|vp engineering|vice president engineering|engineering leader)\b"


def business_models(words: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(has(words, pattern), F.lit(model)) for model, pattern, _ in MODELS]))
    return once(found, lambda models: F.when(F.size(models) > 0, models).otherwise(F.array(F.lit(GENERAL[0]))))


def query_variants(name: Column, industry: Column, country: Column, keywords: Column, size_max: Column) -> Column:
    """Distinct queries in the order in which they are thought of; name: '' where it says nothing."""
    industry, country = F.trim(F.coalesce(industry, F.lit(""))), F.trim(F.coalesce(country, F.lit("")))
    words = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(industry, F.lit("")), F.nullif(country, F.lit("")), keywords)
    here, small = country != "", F.coalesce(size_max <= SMALL, F.lit(False))
    in_place = lambda text: F.when(here, F.concat(text, F.lit(" "), country)).otherwise(text)
    only_here = lambda test, text: F.when(here & test, F.concat(text if not isinstance(text, str) else F.lit(text), F.lit(" "), country))
    shop, health = F.lower(industry).rlike("e-?commerce"), F.lower(industry).contains("health")
    phrase = F.coalesce(*[F.when(has(words, pattern), F.lit(first)) for _, pattern, first in MODELS], F.lit(GENERAL[1]))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in INDUSTRY_PHRASES.items() for x in pair]), F.lower(industry)), F.concat(industry, F.lit(" company")))
    first_two = F.array_join(F.slice(keywords, 1, 2), " ")
    said = name != ""
    queries = [
        *[only_here(shop, q) for q in SHOP_QUERIES],
        only_here(said, name),
        F.when(here & said, F.concat(name, F.lit(" "), industry, F.lit(" "), country)),
        F.when(~here & said, name),
        in_place(phrase),
        F.when(industry != "", in_place(named)),
        F.when(F.size(keywords) > 0, in_place(F.concat(first_two, F.lit(" company")))),
        only_here(health, F.when(small, "healthcare startup").otherwise("healthcare technology company")),
        *[only_here(health, q) for q in HEALTH_QUERIES],
        *[only_here(health & small, q) for q in SMALL_HEALTH_QUERIES],
        only_here(health & (has(words, ENGINEERING_LEADS) | said | small), "healthtech software company"),
        F.when(small & here & (industry != ""), F.concat(F.lit("small "), F.lower(industry), F.lit(" company "), country)),
    ]
    return F.array_distinct(F.filter(F.array(*[F.trim(q) for q in queries]), lambda q: F.coalesce(q != "", F.lit(False))))


def exact_suggestion(typed: Column, known: Column) -> Column:
    clean = F.lower(F.trim(typed))
    return F.get(F.filter(known, lambda s: (clean != "") & (F.lower(s) == clean)), F.lit(0))


def ranked_suggestions(typed: Column, known: Column, most: int = 50) -> Column:
    """Those that begin with what is typed, then those that hold it, each in the list's order."""
    clean = F.lower(F.trim(typed))
    begin = F.filter(known, lambda s: F.lower(s).startswith(clean))
    inside = F.filter(known, lambda s: ~F.lower(s).startswith(clean) & F.lower(s).contains(clean))
    return F.slice(F.when(clean == "", known).otherwise(F.concat(begin, inside)), 1, most)


def spell_suggestion(typed: Column, known: Column) -> Column:
    """The nearest suggestion at an edit distance of two at most, with the same two first letters; none if one is exact."""
    clean = F.lower(F.trim(typed))
    near = F.filter(F.transform(known, lambda s, i: F.struct(F.levenshtein(clean, F.lower(s)).alias("d"), i.alias("i"), s.alias("s"))), lambda x: F.lower(x["s"]).startswith(F.substring(clean, 1, 2)) & (x["d"] <= 2))
    return F.when((F.length(clean) >= 3) & exact_suggestion(typed, known).isNull(), F.get(F.array_sort(near), F.lit(0))["s"])


def is_reply(sender: Column, recipient: Column, subject: Column, original: Column) -> Column:
    """From the recipient, and by its subject an answer: marked as one, or with the first twenty characters of the original."""
    low, old = F.trim(F.lower(F.coalesce(subject, F.lit("")))), F.trim(F.lower(F.coalesce(original, F.lit(""))))
    marked = low.startswith("re:") | low.startswith("fwd:") | ((old != "") & low.contains(F.substring(old, 1, 20)))
    return F.coalesce(F.lower(sender).contains(F.lower(recipient)), F.lit(False)) & marked


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.substring_index(email, "@", 1), F.lit("")), F.lit("User"))


def initials(name: Column, email: Column) -> Column:
    """Two first letters of a name's words, else the first of the address."""
    letters = F.substring(F.array_join(F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.substring(w, 1, 1)), ""), 1, 2)
    return F.upper(F.coalesce(F.nullif(letters, F.lit("")), F.nullif(F.substring(F.trim(F.substring_index(email, "@", 1)), 1, 1), F.lit("")), F.lit("U")))


def masked_key(key: Column) -> Column:
    return F.when(F.length(key) <= 8, "••••••••").otherwise(F.concat(F.substring(key, 1, 3), F.lit("••••"), F.right(key, F.lit(4))))

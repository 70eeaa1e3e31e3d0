"""Which web search results are companies, and what such a company is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .relevance import ORGANISATIONS, PUBLIC_TLD, is_investor, organisation_block
from .text import has, joined

# fixed values: directories, lists and media, which are no target company, and hosts like them
DIRECTORY_DOMAINS = [
    "techbehemoths.com", "clutch.co", "goodfirms.co", "goodfirms.com", "designrush.com", "sortlist.com", "themanifest.com", "crunchbase.com",
    "opencorporates.com", "zoominfo.com", "glassdoor.com", "indeed.com", "yelp.com", "trustpilot.com", "g2.com", "capterra.com",
    "softwaresuggest.com", "extract.co", "topdevelopers.co", "itfirms.co", "selectedfirms.co", "tracxn.com", "bouncewatch.com", "startupill.com",
    "startuppakistan.com.pk", "edtechhub.org", "katalystlabs.pk", "nicpeshawar.pk", "f6s.com", "angel.co", "wellfound.com", "pitchbook.com",
    "dealroom.co", "seedtable.com", "failory.com", "feedspot.com", "meetfrank.com", "business-sweden.com", "linkedin.com", "greenhouse.io",
    "workable.com", "smartrecruiters.com", "teachable.com", "medium.com", "substack.com", "wordpress.com", "blogspot.com", "wixsite.com",
    "tumblr.com", "reddit.com", "quora.com", "pinterest.com", "instagram.com", "tiktok.com", "dawn.com", "tribune.com.pk", "geo.tv", "bbc.com",
    "cnn.com", "forbes.com", "fortune.com", "fortune500.com", "businessinsider.com", "techcrunch.com", "venturebeat.com",
]
DIRECTORY_HOSTS = [
    r"\.teachable\.com$", r"\.wordpress\.com$", r"\.blogspot\.com$", r"\.wixsite\.com$", r"\.github\.io$", r"^nic[a-z0-9-]+\.pk$",
    r"^nic[a-z0-9-]+\.gov\.pk$", r"tracxn\.com$", r"startupill\.com$", r"startuppakistan\.", r"edtechhub\.", r"bouncewatch\.", r"el-mouradia\.",
    r"\.gov\.", r"presidency\.",
]

# fixed values: paths of articles and lists, and titles of such pages
ARTICLE_PATHS = [
    "/blog/", "/blogs/", "/article/", "/articles/", "/news/", "/press/", "/post/", "/posts/", "/story/", "/stories/", "/list/", "/lists/", "/top-",
    "/best-", "/guide/", "/guides/", "/companies/", "/company-list", "/directory/", "/ranking/", "/rankings/", "/category/", "/tag/", "/tags/",
    "/wiki/", "/startups/", "/startup/", "/ecosystem/", "/scenario/", "/reports/", "/insights/", "/resources/", "/jobs/", "/job/", "/careers/",
    "/vacancy/", "/vacancies/", "/hiring/", "/apply/",
]
ARTICLE_TITLES = [
    r"\btop\s+\d*", r"\btop\s+startups\b", r"\bbest\s+\d+", r"\bbest\s+.*startups\b", r"\blist\s+of\b", r"\bcompanies\s+in\b", r"\bcompanies\s+of\b",
    r"\bstartups\s+in\b", r"\bstartups\s+of\b", r"\bstartups\s+leading\b", r"\bed-?tech\s+startups\b", r"\beducation\s+startups\b",
    r"\beducation\s+technology\s+in\b", r"\bsoftware\s+companies\b", r"\bit\s+companies\b", r"\bgrowing\s+tech\b", r"\bindustry\s+report\b",
    r"\bcurrent\s+scenario\b", r"\bleading\s+the\s+way\b", r"\bhow\s+to\b", r"\bwhat\s+is\b", r"\bguide\s+to\b", r"\bultimate\s+guide\b",
    r"\(\d{4}\)", r"\b\d{4}\s+edition\b", r"\bnews\b", r"\bblog\b", r"\barticle\b", r"\breview\b", r"\bcomparison\b", r"\bvs\.?\b", r"\branked\b",
    r"\branking\b", r"\becosystem\b", r"\blandscape\b", r"\boverview\s+of\b",
]

# fixed values: titles of plain pages, names of people, signs of a company's name, of a past one and of a place
PLAIN_PAGES = r"^(home|about(\s+us)?|welcome|contact(\s+us)?|overview|index)$"
PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z'.-]+){1,2}$"
COMPANY_SIGNS = r"\b(inc|llc|ltd|corp|corporation|company|co\.|group|holdings|insurance|bank|technologies|tech|solutions|services|partners|consulting|media|labs|systems|software|ventures|capital|global|international|gmbh|plc|pty|cloud|data|digital|network|analytics|platform|studio|works|dynamics|interactive|security|robotics|automation)\b"
PAST = r"\(\d{4}[–-]\d{4}\)|\(\d{4}[–-]present\)|\bdefunct\b|\bformer\b|\bacquired by\b|\bmerged into\b|^(List of|Category:|Template:)"
PLACES = r"^(United States|United Kingdom|Canada|Australia|Germany|France|India|China|Japan|California|New York|Texas|Florida|London|Paris|Europe|Asia|Africa|Algeria|Sweden|Norway|Denmark|Finland|Pakistan|Spain|Italy|Brazil|Mexico)\b"
LISTS = r"\b(top|best)\s+\d+|\blist\s+of\b|\bstartups\s+in\b|\bdiscover\s+the\s+best\b|\bcompanies\s+are\s+available\b"
SITE_ENDING = r"\s*[-|–—]\s*(home|homepage|official site|official website).*$"


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def host(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")


def is_directory(domain: Column) -> Column:
    """A listed host or one below it: each of its endings is looked up, so the list may be of any length."""
    own = host(domain)
    parts = F.split(own, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(endings, F.array(*map(F.lit, DIRECTORY_DOMAINS))) | has(own, any_of(DIRECTORY_HOSTS))


def is_article_url(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^(?:https?://)?[^/?#]+([^?#]*)", 1))
    return F.coalesce(F.exists(F.array(*map(F.lit, ARTICLE_PATHS)), lambda s: path.contains(s)), F.lit(False))


def is_article_title(title: Column) -> Column:
    """No title, one beyond 72 characters, or one that an article has; a plain page's is none."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    return (clean == "") | (F.length(clean) > 72) | (~has(clean, PLAIN_PAGES) & has(clean, any_of(ARTICLE_TITLES)))


def is_person(title: Column) -> Column:
    clean = F.trim(F.coalesce(title, F.lit("")))
    return F.length(clean).between(1, 48) & ~has(clean, COMPANY_SIGNS) & ~clean.rlike(r"\d") & clean.rlike(PERSON)


def is_past_or_place(name: Column) -> Column:
    clean = F.trim(F.coalesce(name, F.lit("")))
    return (clean == "") | is_person(clean) | has(clean, PLACES) | has(clean, r"^welcome\s+to\b") | has(clean, PAST)


def reject_reason(url: Column, domain: Column, title: Column, snippet: Column) -> Column:
    """The first of thirteen reasons why a result is no company, or null."""
    text = joined(title, snippet, host(domain))
    kinds = any_of([pattern for _, pattern in ORGANISATIONS])
    return (
        F.when(host(domain) == "", "no_domain")
        .when(has(host(domain), PUBLIC_TLD), "non_commercial_domain")
        .when(is_directory(domain), "directory")
        .when(is_article_url(url), "article_url")
        .when(is_article_title(title), "article_title")
        .when(is_person(title), "person")
        .when(is_past_or_place(title), "historical")
        .when(has(F.trim(title), kinds), "non_commercial_title")
        .when(organisation_block(text, domain).isNotNull(), "non_commercial_org")
        .when(is_investor(text, title, domain), "investor")
        .when(has(snippet, LISTS), "listicle")
        .when(has(url, r"\.pdf($|\?)"), "pdf")
        .when(has(url, r"/in/[a-z0-9_-]+"), "profile")
    )


def brand(domain: Column) -> Column:
    first = F.substring_index(F.regexp_replace(domain, r"^www\.", ""), ".", 1)
    return F.when(first == "", domain).otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1000)))


def company_name(title: Column, domain: Column) -> Column:
    """A result's title without what pages add to a name; the domain's brand where no name is left."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    bare = F.trim(F.regexp_replace(clean, r"(?i)^welcome\s+to\s+", ""))
    parts = F.split(bare, r"\s+[-|–—]\s+")
    first = F.trim(F.get(parts, F.lit(0)))
    name = F.when((F.size(parts) > 1) & F.length(first).between(2, 60) & ~is_article_title(first), first).otherwise(bare)
    name = F.trim(F.regexp_replace(name, f"(?i){SITE_ENDING}", ""))
    name = F.trim(F.regexp_replace(name, r"\s*\([^)]{0,40}\)\s*$", ""))
    nameless = (clean == "") | has(clean, PLAIN_PAGES) | (name == "") | is_article_title(name) | is_person(name)
    return F.when(nameless, brand(domain)).otherwise(F.substring(name, 1, 120))

"""Queries over web search results, on stated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, hits, people
from ..sources.cases import case_query

C = F.col

_HITS = [  # url, domain, title, snippet, reason
    ("https://acme.example/", "acme.example", "Acme Robotics Inc", "We build our own robots", None),
    ("https://x.example/", "", "Acme Robotics Inc", "", "no_domain"),
    ("https://city.gov/", "city.gov", "Acme Robotics Inc", "", "non_commercial_domain"),
    ("https://www.clutch.co/acme", "www.clutch.co", "Acme Robotics Inc", "", "directory"),
    ("https://acme.blogspot.com/", "acme.blogspot.com", "Acme Robotics Inc", "", "directory"),
    ("https://acme.example/blog/robots", "acme.example", "Acme Robotics Inc", "", "article_url"),
    ("https://acme.example/", "acme.example", "Top 10 robots", "", "article_title"),
    ("https://acme.example/", "acme.example", "A very long headline about robots that goes on and on and on and never stops", "", "article_title"),
    ("https://acme.example/", "acme.example", "Jane Doe", "", "person"),
    ("https://acme.example/", "acme.example", "Acme Robotics (1999-2010)", "", "historical"),
    ("https://acme.example/", "acme.example", "Welcome to Acme", "", "historical"),
    ("https://acme.example/", "acme.example", "Germany robotics", "", "historical"),
    ("https://acme.example/", "acme.example", "The University of Acme", "", "non_commercial_title"),
    ("https://acme.example/", "acme.example", "Acme Robotics Inc", "A nonprofit for robots", "non_commercial_org"),
    ("https://acme.example/", "acme.example", "Acme Growth 7", "A venture capital firm", "investor"),
    ("https://acme.example/", "acme.example", "Acme Robotics Inc", "Best 20 robots of the year", "listicle"),
    ("https://acme.example/a.pdf?x=1", "acme.example", "Acme Robotics Inc", "", "pdf"),
    ("https://acme.example/in/jane", "acme.example", "Acme Robotics Inc", "", "profile"),
    ("https://acme.example/about", "acme.example", "About us", "", None),
]
case_query(
    "FLT12_search_hits",
    {c: [h[i] for h in _HITS] for i, c in enumerate(("url", "domain", "title", "snippet"))},
    lambda df: {"reason": hits.reject_reason(C("url"), C("domain"), C("title"), C("snippet")), "kept": hits.reject_reason(C("url"), C("domain"), C("title"), C("snippet")).isNull()},
    {"reason": [h[4] for h in _HITS], "kept": [h[4] is None for h in _HITS]},
)

_PAGES = [
    ("Acme Corp - Official Site", "acme.example", "Acme Corp"), ("Welcome to Acme Labs", "acme.example", "Acme Labs"), ("Acme | Robots for everyone", "acme.example", "Acme"), ("Home", "www.acme.example", "Acme"), ("", "acme.example", "Acme"),
    ("Acme Systems (Berlin)", "acme.example", "Acme Systems"), ("Jane Doe", "doe.example", "Doe"), ("How to build a robot", "robots.example", "Robots"), ("Acme Tech—homepage", "acme.example", "Acme Tech"), ("Top 10 robots | Acme Labs", "acme.example", "Acme"), (None, "acme.example", "Acme"),
]
case_query("STR15_company_name", {"title": [p[0] for p in _PAGES], "domain": [p[1] for p in _PAGES]}, lambda df: {"name": hits.company_name(C("title"), C("domain"))}, {"name": [p[2] for p in _PAGES]})

_PROFILES = [  # name, job title, headline, text, url, resolved name, at the company, named, score
    ("Jane Doe", "Chief Technology Officer", "Technology Officer", "Jane Doe at Acme", "https://www.linkedin.com/in/jane-doe-1", "Jane Doe", True, True, 100),
    ("Jane Doe", "CTO", "Painter", "the cto jane doe of Acme", "https://www.linkedin.com/in/jd", "J. Smith", False, True, 28 + 12 + 10 + 12),
    ("Jane Doe", "CTO", "Painter", "somebody", "https://www.linkedin.com/in/xy", "J. Smith", False, False, 0),
    ("Jane Doe", "CTO", "Painter", "somebody", "https://www.linkedin.com/in/janedoe", "Jane B. Doe", False, False, 35 + 22),
    ("Jane", "Founder", "Founder", "Jane | founder", "https://www.linkedin.com/in/jane", "Jane Doe", False, True, 35 + 12 + 18 + 12),
]


def _profiles(df):
    own, seen = people.same_person(C("name"), C("resolved")), contacts.name_in_text(C("name"), C("text"))
    title, role = contacts.titles_overlap(C("title"), C("headline")), contacts.has_role(C("text"), "cto")
    score = contacts.profile_score(own, seen, contacts.slug_has_name(C("url"), C("name")), title, role, C("here"), C("named"))
    return {"score": score, "kept": (score >= 45) & C("here"), "kept_anywhere": score >= 30}


case_query(
    "SCO13_profile_candidates",
    {c: [p[i] for p in _PROFILES] for i, c in enumerate(("name", "title", "headline", "text", "url", "resolved", "here", "named"))},
    _profiles,
    {"score": [p[8] for p in _PROFILES], "kept": [p[8] >= 45 and p[6] for p in _PROFILES], "kept_anywhere": [p[8] >= 30 for p in _PROFILES]},
)

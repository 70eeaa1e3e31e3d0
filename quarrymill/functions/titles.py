"""Job titles: which roles a wanted title stands for, and whether a person holds one of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, first_match, has

# fixed values: titles that say nothing
UNKNOWN_TITLES = ["team member", "staff member", "employee", "member", "unknown", "n/a", ""]

# fixed values: roles that a wanted title stands for
ROLES = {
    "ceo": ["ceo", "chief executive officer"],
    "cto": ["cto", "chief technology officer", "chief technical officer", "vp engineering", "vice president of engineering", "vp of engineering", "head of technology", "head of engineering", "engineering director"],
    "cfo": ["cfo", "chief financial officer"],
    "coo": ["coo", "chief operating officer"],
    "cmo": ["cmo", "chief marketing officer"],
    "cpo": ["cpo", "chief product officer"],
    "chro": ["chro", "chief human resources officer"],
    "founder": ["founder", "co-founder", "cofounder", "co founder"],
    "president": ["president", "chairman", "chairperson"],
    "director": ["director", "managing director", "executive director", "marketing director", "sales director", "it director"],
    "manager": ["general manager", "marketing manager", "product manager", "sales manager", "business manager", "operations manager", "regional manager", "country manager"],
    "owner": ["owner", "co-owner", "business owner", "proprietor"],
    "vice president": ["vice president", "vp"],
    "svp": ["svp", "senior vice president"],
    "evp": ["evp", "executive vice president"],
    "vp": ["vp", "vice president", "vp engineering", "vp sales", "vp marketing", "vp product"],
    "vp engineering": ["vp engineering", "v.p. engineering", "vice president engineering", "vice president of engineering", "vice president, engineering", "vp of engineering", "v.p. of engineering", "svp engineering", "senior vice president engineering", "evp engineering", "executive vice president engineering"],
    "head of growth": ["head of growth", "growth lead", "director of growth"],
    "head of": ["head of"],
    "partner": ["partner"],
    "chairman": ["chairman", "chairperson", "chairwoman", "chair", "founding chairman"],
    "chairperson": ["chairperson", "chairman", "chairwoman"],
    "deputy": ["deputy ceo", "deputy"],
}
DEFAULT_TITLES = ["CEO", "CTO", "Founder"]

# fixed values: people who do not decide, and those who do although their title has a word of them
NO_EXECUTIVE = r"\b(software engineer|engineer|developer|designer|analyst|intern|assistant|coordinator|specialist|recruiter|account executive|customer success|sales rep|support|technician|writer|editor|associate)\b"
NO_DECISION = r"\b(advisor|adviser|advisory board|board member|board of directors|non-executive director|independent director|consultant|consulting partner|internship|intern\b|fellow\b|volunteer|mentor|emeritus|honorary|retired|alumni|ex[-\s]employee|former\s+(ceo|cto|cfo|coo|founder|president|director))\b"
STILL_EXECUTIVE = r"\b(chief|founder|president|director|owner|vp|head of)\b"
EXECUTIVE_MANAGERS = r"\b(general manager|managing manager|country manager|regional manager|national manager|global manager|business manager|sales manager|marketing manager|product manager|operations manager|engineering manager|finance manager)\b"
VP_ENGINEERING = r"\bvp\b[^|]{0,40}\b(engineering|technology|tech|software|digital|it|platform|data)\b|\bvice president\b[^|]{0,40}\b(engineering|technology|tech|software|digital|it|platform|data)\b|\b(svp|evp|senior vice president|executive vice president)\b[^|]{0,40}\b(engineering|technology|tech)\b"

# fixed values: rank of who decides
DECISION_RANKS = [
    (r"\b(co[- ]?founder|cofounder)\b", 100),
    (r"\bfounder\b", 98),
    (r"\bceo\b|chief executive", 96),
    (r"\bcto\b|chief technology", 92),
    (r"\bcfo\b|chief financial", 90),
    (r"\bcoo\b|chief operating", 88),
    (r"\bpresident\b", 84),
    (r"\bvp\b|vice president", 82),
    (r"\bowner\b", 80),
    (r"\bmanaging director\b", 78),
    (r"\bdirector\b", 76),
    (r"\bhead of\b", 74),
    (r"\bgeneral manager\b", 72),
]


def role_pattern(wanted: list[str]) -> tuple[str, list[str]]:
    """(one alternation for the roles of a single word, the roles of several, which match anywhere)."""
    keys = [" ".join(w.lower().split()) for w in (wanted or DEFAULT_TITLES)]
    roles = sorted({r for k in keys for r in ROLES.get(k, [k])})
    single = [r.replace("-", "\\-") for r in roles if " " not in r]
    return r"\b(" + "|".join(single) + r")\b" if single else "", [r for r in roles if " " in r]


def title_matches(title: Column, wanted: list[str]) -> Column:
    """Whether a title is one of the wanted ones; no wanted ones stand for the default."""
    clean = collapse(F.coalesce(title, F.lit("")))
    single, several = role_pattern(wanted)
    held = has(clean, single) if single else F.lit(False)
    for role in several:
        held = held | clean.contains(role)
    keys = [" ".join(w.lower().split()) for w in wanted]
    if any("vp engineering" in k or "vice president engineering" in k or k == "vp eng" for k in keys):
        held = held | has(clean, VP_ENGINEERING)
    barred = has(clean, NO_DECISION) | (has(clean, NO_EXECUTIVE) & ~has(clean, STILL_EXECUTIVE))
    if "manager" in keys:
        barred = barred | (has(clean, r"\bmanager\b") & ~has(clean, EXECUTIVE_MANAGERS))
    return ~clean.isin(UNKNOWN_TITLES) & ~barred & held


def decision_rank(title: Column) -> Column:
    return first_match(F.trim(title), DECISION_RANKS, 0)


def title_matches_any(title: Column, wanted: Column) -> Column:
    """title_matches() against a column of title lists: a row's own roles are looked up and asked one by one."""
    clean = collapse(F.coalesce(title, F.lit("")))
    asked = F.when(F.size(F.coalesce(wanted, F.array().cast("array<string>"))) > 0, wanted).otherwise(F.array(*map(F.lit, DEFAULT_TITLES)))
    keys = F.transform(asked, collapse)
    table = F.create_map(*[x for role, names in ROLES.items() for x in (F.lit(role), F.array(*map(F.lit, names)))])
    roles = F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(table, k), F.array(k))))
    held = F.exists(roles, lambda r: F.when(r.contains(" "), clean.contains(r)).otherwise(F.rlike(clean, F.concat(F.lit(r"\b"), F.replace(r, F.lit("-"), F.lit(r"\-")), F.lit(r"\b")))))
    vp = F.exists(keys, lambda k: k.contains("vp engineering") | k.contains("vice president engineering") | (k == "vp eng"))
    barred = has(clean, NO_DECISION) | (has(clean, NO_EXECUTIVE) & ~has(clean, STILL_EXECUTIVE))
    barred = barred | (F.array_contains(keys, "manager") & has(clean, r"\bmanager\b") & ~has(clean, EXECUTIVE_MANAGERS))
    return ~clean.isin(UNKNOWN_TITLES) & ~barred & (held | (vp & has(clean, VP_ENGINEERING)))

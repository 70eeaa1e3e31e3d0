"""Who is no customer: historical, media, conflicting, non-commercial and investing organisations; and person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has

# fixed values: media domains and signals
MEDIA_DOMAINS = ["fortune.com", "forbes.com", "bloomberg.com", "reuters.com", "wsj.com", "nytimes.com", "businessinsider.com", "techcrunch.com", "venturebeat.com", "theverge.com", "wired.com", "cnbc.com", "bbc.com", "cnn.com", "hbr.org", "economist.com", "ft.com", "time.com", "inc.com", "fastcompany.com", "entrepreneur.com"]
MEDIA = r"\b(magazine|publisher|publishing|newspaper|newsroom|media group|broadcasting|television network|cable news|journalism|editorial|fortune 500 list|business media)\b"
CONGLOMERATE = r"\b(conglomerate|diversified holdings|multinational corporation|fortune 500|global 500|s&p 500|holding company|parent company of|subsidiaries across)\b"
HISTORICAL = r"\b(defunct|dissolved|former company|was acquired|merged into|bankruptcy|ceased operations|no longer operating|historical company|formerly known as)\b"
NO_SAAS = r"\b(hardware|semiconductor|semiconductors|chip maker|chipmaker|telecom|telecommunications|telecommunication|mobile operator|wireless carrier|network equipment|networking equipment|fpga|foundry|router manufacturer|switch manufacturer|base station|handset|smartphone maker|device manufacturer|storage hardware|server hardware|optical networking|5g equipment)\b"
STRONG_SAAS = r"\b(saas|software as a service|b2b software|cloud software|software platform|subscription software|enterprise software|software company|software product|api platform|devtools|developer tools|application software)\b"
STRONG_TECH = r"\b(software|saas|cloud software|cloud platform|cybersecurity|devops|machine learning|artificial intelligence|\bai platform|data platform|it services|technology company|software company|software product|enterprise software)\b"

# fixed values: kinds of organisations that sell nothing, in their order
PUBLIC_TLD = r"\.(edu|mil|ac\.uk|museum|int)(\.|$)|\.gov(\.|$)|\.govt\."
ORGANISATIONS = [
    ("government", r"\b(government agency|federal agency|municipal|public sector|ministry of|department of|city of|county of|state of|parliament|legislature|embassy)\b"),
    ("military", r"\b(military|armed forces|defence force|defense department|ministry of defence|ministry of defense|nato\b|pentagon|veterans affairs)\b"),
    ("university", r"\b(university|college|polytechnic|institute of technology|school of|faculty of|academic institution|higher education|campus)\b"),
    ("museum", r"\b(museum|art gallery|cultural center|heritage site|exhibition hall|memorial foundation)\b"),
    ("nonprofit", r"\b(nonprofit|non-profit|not-for-profit|ngo\b|charity|charitable foundation|501\(c\)|501c3|philanthrop)\b"),
]
PORTAL = r"\b(wikipedia|encyclopedia|dictionary|reference guide|how to guide|what is|definition of)\b"
INVESTOR = r"\b(venture capital|venture capitalist|vc firm|vc fund|startup accelerator|accelerator program|business incubator|startup incubator|incubator program|seed fund|early[- ]stage fund|hands[- ]on venture capital|angel fund|investment program for startups)\b"
OPERATING = r"\b(we build|our product|our platform|software company|saas platform|our solution|customers use|subscription|api platform|we develop|we sell)\b"
INVESTOR_DOMAINS = ["ycombinator.com", "ycombinator.org", "techstars.com", "500.co", "plugandplaytechcenter.com", "seedcamp.com", "verdane.com", "eqtgroup.com", "kinnevik.com", "norrsken.org", "sequoiacap.com", "a16z.com", "accel.com", "balderton.com", "creandum.com"]

# fixed values: what stands where names stand, but is none
NO_NAMES = [
    r"^our (mission|vision|values|journey|legacy|team|people|story|history|culture)$",
    r"^(corporate office|advertise|subscribe|follow us|know more|insights|how we|work at|featured episode)$",
    r"^(courage|collaboration|growth|innovation|agility|leadership|upcoming events)$",
    r"^(redefining|revolutionizing|enabling|entering|innovating|conversations with)",
    r"unlocking brand",
    r"^are you looking",
    r"^(fever fm|punjabi fever|radio nasha|radio one)$",
    r"^(linkedin|profile|unknown|team|staff|contact us|get in touch|read more)$",
    r"^(privacy policy|terms of service|cookie policy)$",
    r"^(partner|sales|customer|technical|general|media|press)\s+(enquiry|inquiry|request|information)$",
    r"^your\b",
    r"^our\b.+\b(partner|solutions|services)\b",
    r"\b(product modernization|digital transformation|trusted partner)\b",
]
TAGLINE_START = r"^(your|our|we are|the leading)\b"
TAGLINE_WORD = r"^\W*(your|product|modernization|digital|transformation|trusted|leading|innovation|solutions|services|partner|provider|empowering|delivering|technology)\W*$"
NAME = r"^[A-Z][A-Za-z'.-]+(\s+[A-Z][A-Za-z'.-]+){0,3}$"
COMPANY_END = r"(inc|llc|ltd|corp|company|solutions|services|team|department)$"

# fixed values: countries in the order in which a text is searched for them, then abbreviations
COUNTRY_NAMES = ["pakistan", "united states", "united kingdom", "india", "germany", "france", "canada", "australia", "united arab emirates", "singapore", "netherlands", "brazil", "mexico", "spain", "italy", "sweden", "switzerland", "ireland", "south africa", "nigeria", "kenya", "bangladesh", "sri lanka", "nepal", "saudi arabia", "japan", "south korea", "china", "indonesia", "malaysia", "philippines", "vietnam", "turkey", "egypt", "argentina", "colombia", "chile", "new zealand", "poland", "norway", "denmark"]
COUNTRY_SHORT = {"usa": "United States", "uk": "United Kingdom", "uae": "United Arab Emirates", "pk": "Pakistan"}

# fixed values: what troubles an industry, a role or a user of a technology
INDUSTRY_PAINS = {
    "healthcare": ["HIPAA compliance and patient data security", "integrating legacy EHR systems with modern tools", "reducing clinician workflow friction"],
    "fintech": ["scaling payment infrastructure reliably", "meeting regulatory and audit requirements", "reducing fraud and improving transaction monitoring"],
    "saas": ["shipping product features faster without breaking quality", "reducing churn through better product experience", "scaling the platform as customer volume grows"],
    "e-commerce": ["improving checkout conversion and site performance", "managing inventory and order fulfillment at scale", "personalizing the customer journey across channels"],
    "manufacturing": ["connecting shop-floor systems with cloud analytics", "reducing downtime through better operational visibility", "modernizing supply chain and production tooling"],
}
ROLE_PAINS = {"ceo": "accelerating product roadmap without overextending the team", "founder": "validating product direction while keeping burn under control", "cto": "reducing technical debt while maintaining delivery velocity", "vp sales": "equipping the sales team with better tooling and insights", "marketing director": "proving marketing ROI with better attribution and automation"}
TECHNOLOGY_PAINS = {"react": "modernizing the frontend experience", "aws": "optimizing cloud costs and infrastructure reliability", "kubernetes": "simplifying deployment and container orchestration", "salesforce": "connecting CRM workflows with custom product data", "hubspot": "automating lead nurturing across marketing and sales"}


def is_media(text: Column, domain: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(domain), r"^www\.", "").isin(MEDIA_DOMAINS), F.lit(False)) | has(text, MEDIA)


def organisation_block(text: Column, domain: Column) -> Column:
    """Why an organisation sells nothing, or null."""
    out = F.when(has(text, PORTAL) & ~has(text, r"\b(software|saas|technology)\b"), "information_portal")
    for reason, pattern in reversed(ORGANISATIONS):
        out = F.when(has(text, pattern), reason).otherwise(out)
    return F.when(has(F.regexp_replace(F.lower(domain), r"^www\.", ""), PUBLIC_TLD), "non_commercial_domain").otherwise(out)


def is_investor(text: Column, name: Column, domain: Column) -> Column:
    """Investors and accelerators that show no product of their own."""
    known = F.coalesce(F.regexp_replace(F.lower(domain), r"^www\.", "").isin(INVESTOR_DOMAINS), F.lit(False)) | has(name, r"\by combinator\b") | has(text, r"\bverdane\b")
    return (known | has(text, INVESTOR)) & ~has(text, OPERATING)


def strong_signal(text: Column, industry: Column, saas: bool) -> Column:
    if saas:
        return has(text, STRONG_SAAS) | has(industry, r"\bsaas\b|\bsoftware\b")
    return has(text, STRONG_TECH) | has(industry, r"\btechnology\b|\bsoftware\b|\bsaas\b")


def plausible_name(name: Column) -> Column:
    """Two to four capitalised words of a person, after titles such as Dr. are taken off."""
    clean = F.trim(F.regexp_replace(F.replace(F.trim(name), F.lit("’"), F.lit("'")), r"(?i)^(prof(essor)?\.?|dr\.?|mr\.?|mrs\.?|ms\.?|miss)\s+", ""))
    words = F.split(clean, r"\s+")
    cased = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100)))), " ")
    selling = F.size(F.filter(words, lambda w: w.rlike(f"(?i){TAGLINE_WORD}"))) >= 2
    tagline = has(clean, TAGLINE_START) | (has(clean, r"\b(modernization|transformation)\b") & has(clean, r"\bpartner\b")) | ((F.size(words) >= 4) & selling)
    listed = has(clean, "(?:" + "|".join(NO_NAMES) + ")")
    return F.coalesce(F.length(clean).between(3, 60) & ~listed & ~tagline & cased.rlike(NAME) & ~has(clean, COMPANY_END), F.lit(False))


def country_in(text: Column) -> Column:
    """The first listed country in the text, else an abbreviation that stands as a word."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for short, name in reversed(COUNTRY_SHORT.items()):
        out = F.when(has(low, rf"\b{short}\b"), name).otherwise(out)
    for name in reversed(COUNTRY_NAMES):
        out = F.when(low.contains(name), name.title()).otherwise(out)
    return out


def pain_points(industry: Column, role: Column, technologies: Column, employees: Column) -> Column:
    """At most four: of the industry, the role, the technologies in their order, and the size."""
    none = F.array().cast("array<string>")
    general = F.array(F.concat(F.lit("keeping pace with digital transformation in "), industry), F.lit("delivering reliable software without slowing down the business"))
    of_industry = F.when(F.coalesce(industry, F.lit("")) == "", none).otherwise(general)
    for key, points in reversed(INDUSTRY_PAINS.items()):
        of_industry = F.when(F.lower(industry).contains(key), F.array(*map(F.lit, points))).otherwise(of_industry)
    of_role = none
    for key, point in reversed(ROLE_PAINS.items()):
        of_role = F.when(F.lower(role).contains(key), F.array(F.lit(point))).otherwise(of_role)
    of_tool = F.flatten(F.transform(technologies, lambda t: F.array_compact(F.array(*[F.when(F.lower(t).contains(k), p) for k, p in TECHNOLOGY_PAINS.items()]))))
    of_size = F.when(employees < 50, F.array(F.lit("doing more with a lean engineering team"))).when(employees > 500, F.array(F.lit("aligning multiple teams around a consistent product vision"))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(of_industry, of_role, of_tool, of_size)), 1, 4)


def founded(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\b(?:founded|established|since)\s*(?:in\s*)?((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def mock_status(email: Column) -> Column:
    """A verifier without a network: the local part or the host says the answer."""
    local, host = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    return (
        F.when(~email.contains("@") | (local == "") | (host == ""), "invalid")
        .when(local.startswith("invalid") | local.contains("bounce"), "invalid")
        .when(local.startswith("risky") | local.startswith("catchall") | host.startswith("catchall."), "risky")
        .when(local.startswith("disposable"), "invalid")
        .when(local.startswith("unknown"), "unknown")
        .otherwise("valid")
    )


def mail_of_json(content: Column) -> Column:
    """struct(subject, body) of a JSON answer, fenced or not; null if either is missing or empty."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    parsed = F.from_json(F.when(fenced != "", fenced).otherwise(F.trim(content)), "subject string, body string")
    mail = F.struct(F.trim(parsed["subject"]).alias("subject"), F.trim(parsed["body"]).alias("body"))
    return F.when((F.length(mail["subject"]) > 0) & (F.length(mail["body"]) > 0), mail)

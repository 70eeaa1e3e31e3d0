"""Rules of a few lines each: countries, robots, searches, weights, mail texts, dates, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import countries
from .text import decode_entities, is_domain, normalize_domain, once, snippet, strip_quoted

# fixed values: codes of countries in public registers and entities of a public knowledge base
ISO_CODES = {
    "pakistan": "pk", "united states": "us", "united kingdom": "gb", "india": "in", "angola": "ao", "canada": "ca", "australia": "au", "germany": "de", "france": "fr", "spain": "es", "italy": "it", "netherlands": "nl",
    "sweden": "se", "norway": "no", "denmark": "dk", "finland": "fi", "ireland": "ie", "switzerland": "ch", "belgium": "be", "austria": "at", "poland": "pl", "brazil": "br", "mexico": "mx", "argentina": "ar", "chile": "cl",
    "colombia": "co", "south africa": "za", "nigeria": "ng", "kenya": "ke", "egypt": "eg", "united arab emirates": "ae", "saudi arabia": "sa", "singapore": "sg", "malaysia": "my", "indonesia": "id", "philippines": "ph",
    "thailand": "th", "vietnam": "vn", "japan": "jp", "china": "cn", "south korea": "kr", "new zealand": "nz", "bangladesh": "bd", "sri lanka": "lk", "nepal": "np", "turkey": "tr", "portugal": "pt", "greece": "gr",
    "czechia": "cz", "czech republic": "cz", "romania": "ro", "hungary": "hu", "ukraine": "ua", "israel": "il", "taiwan": "tw", "hong kong": "hk",
}
ENTITIES = {
    "pakistan": "Q843", "united states": "Q30", "united kingdom": "Q145", "india": "Q668", "angola": "Q916", "canada": "Q16", "australia": "Q408", "germany": "Q183", "france": "Q142", "sweden": "Q34", "norway": "Q20",
    "denmark": "Q35", "finland": "Q33", "ireland": "Q27", "switzerland": "Q39", "brazil": "Q155", "mexico": "Q96", "japan": "Q17", "china": "Q148", "singapore": "Q334", "united arab emirates": "Q878", "saudi arabia": "Q851",
    "south africa": "Q258", "netherlands": "Q55", "spain": "Q29", "italy": "Q38", "belgium": "Q31", "austria": "Q40", "poland": "Q36", "bangladesh": "Q902", "indonesia": "Q252", "malaysia": "Q833", "philippines": "Q928",
    "thailand": "Q869", "vietnam": "Q881", "south korea": "Q884", "new zealand": "Q664", "turkey": "Q43", "israel": "Q801", "argentina": "Q414", "chile": "Q298", "colombia": "Q739", "nigeria": "Q1033", "kenya": "Q114", "egypt": "Q79",
}

# fixed values: most entries of a search's lists, by field
MOST = {"keywords": 20, "technologies": 20, "job_titles": 10, "exclude_industries": 15, "exclude_keywords": 20, "exclude_countries": 15}
MOST_DOMAINS, LONGEST_NAME = 50, 100


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def iso_code(country: Column) -> Column:
    return _lookup(ISO_CODES, countries.normalize(country))


def entity(country: Column) -> Column:
    return _lookup(ENTITIES, countries.normalize(country))


def country_of_domain(domain: Column) -> Column:
    """What the last of at least two parts of a host says."""
    host = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    return F.when(host.contains("."), _lookup(countries.TLDS, F.substring_index(host, ".", -1)))


def robots_rules(content: Column, agent: str) -> Column:
    """Paths that a robots file forbids to all or to this agent.

    The lines are folded once: a user-agent line opens or closes what follows, a disallow line counts while open.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: (x != "") & ~x.startswith("#"))

    def step(state: Column, line: Column) -> Column:
        key, value = F.lower(F.substring_index(line, ":", 1)), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        ours = (value == "*") | F.lower(value).contains(agent)
        opened = F.when(key == "user-agent", ours).otherwise(state["opened"])
        rules = F.when((key == "disallow") & state["opened"] & (value != ""), F.concat(state["rules"], F.array(value))).otherwise(state["rules"])
        return F.struct(opened.alias("opened"), rules.alias("rules"))

    start = F.struct(F.lit(False).alias("opened"), F.array().cast("array<string>").alias("rules"))
    return F.aggregate(lines, start, step)["rules"]


def may_fetch(path: Column, rules: Column) -> Column:
    return ~F.exists(rules, lambda r: (r == "/") | F.startswith(path, r))


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def search_problems(row: dict[str, Column]) -> Column:
    """struct(field, message) of every rule that a search breaks, the last one of a field; texts as they are typed."""
    clean = lambda c: F.trim(F.coalesce(row[c], F.lit("")))
    number = {c: F.regexp_extract(clean(c), r"^([+-]?\d+)", 1).try_cast("int") for c in ("size_min", "size_max")}
    bad = {c: (clean(c) != "") & number[c].isNull() for c in number}
    low, high = number["size_min"], number["size_max"]
    size = (
        F.when(low > high, "Minimum size cannot exceed maximum size.")
        .when(high < 1, "Maximum company size must be at least 1.")
        .when(low < 1, "Minimum company size must be at least 1.")
        .when(bad["size_min"] | bad["size_max"], "Company size must be a valid number.")
        .when(low.isNull() & high.isNull(), "Company size is required.")
    )
    lists = {c: tags(row[c]) for c in MOST}
    over = {c: F.when(F.size(lists[c]) > most, f"Maximum {most} {label} allowed.") for (c, most), label in zip(MOST.items(), ("keywords", "technologies", "job titles", "excluded industries", "excluded keywords", "excluded countries"), strict=True)}
    typed = tags(row["exclude_domains"])
    wrong = F.get(F.filter(typed, lambda d: ~is_domain(normalize_domain(d))), F.lit(0))
    own = lambda c, mine: F.array_contains(lists[c], clean(mine))
    found = {
        "name": F.when(clean("name") == "", "Search name is required.").when(F.length(clean("name")) > LONGEST_NAME, f"Name must be {LONGEST_NAME} characters or less."),
        "industry": F.when(clean("industry") == "", "Industry is required."),
        "country": F.when(clean("country") == "", "Country is required."),
        "companySize": size,
        "jobTitles": F.coalesce(over["job_titles"], F.when(F.size(lists["job_titles"]) == 0, "At least one job title is required.")),
        "keywords": over["keywords"],
        "technologies": over["technologies"],
        "excludeDomains": F.when(wrong.isNotNull(), F.concat(F.lit('"'), wrong, F.lit('" is not a valid domain.'))).when(F.size(F.array_distinct(F.transform(typed, normalize_domain))) > MOST_DOMAINS, f"Maximum {MOST_DOMAINS} excluded domains allowed."),
        "excludeIndustries": F.when(own("exclude_industries", "industry"), "Cannot exclude the same industry you are targeting.").otherwise(over["exclude_industries"]),
        "excludeKeywords": over["exclude_keywords"],
        "excludeCountries": F.when(own("exclude_countries", "country"), "Cannot exclude the same country you are targeting.").otherwise(over["exclude_countries"]),
    }
    return F.array_compact(F.array(*[F.when(message.isNotNull(), F.concat(F.lit(field + ": "), message)) for field, message in found.items()]))


WEIGHTS = ["industryMatch", "companyTypeVerified", "companySize", "locationMatch", "jobRoleMatch", "technologyMatch"]


def six_weights(industry: Column, size: Column, location: Column, role: Column, technology: Column) -> list[Column]:
    """Five stored weights to six: the industry's is split, its half rounded up, the rest for the type."""
    half = F.floor(industry / 2 + 0.5).cast("int")
    return [half, industry - half, size, location, role, technology]


def weights_problem(weights: list[Column]) -> Column:
    """The first weight that is no whole number from 0 to 100, or a sum that is not 100; null if all is well."""
    single = [F.when(w.isNull() | (w != F.floor(w)) | (w < 0) | (w > 100), f"{name} must be an integer between 0 and 100.") for name, w in zip(WEIGHTS, weights, strict=True)]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return F.coalesce(*single, F.when(total != 100, F.concat(F.lit("Weights must sum to 100 (currently "), F.format_string("%.0f", total.cast("double")), F.lit(")."))))


def part_text(payload: Column, depth: int = 3) -> Column:
    """The plain text of a mail's JSON: its own part, else of its parts the first plain one, else the first that holds one.

    Parts nest to any depth in theory; depth is as far as the columns go.  What a step finds is bound to a name, so that no
    step repeats those before it.
    """

    def decoded(data: Column) -> Column:
        fixed = F.translate(data, "-_", "+/")
        pad = F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4)))
        return F.try_to_binary(F.concat(fixed, pad), F.lit("base64")).cast("string")

    def own(payload: Column) -> Column:
        return F.when(F.get_json_object(payload, "$.mimeType") == "text/plain", once(F.get_json_object(payload, "$.body.data"), lambda data: F.when(data != "", decoded(data))))

    def below(parts: Column) -> Column:
        plain = F.get(F.filter(parts, lambda p: F.get_json_object(p, "$.mimeType") == "text/plain"), F.lit(0))
        nested = F.get(F.filter(F.transform(parts, lambda p: part_text(p, depth - 1)), lambda t: F.coalesce(t != "", F.lit(False))), F.lit(0))
        return once(plain, lambda p: F.when(p.isNotNull(), own(p)).otherwise(nested))

    if not depth:
        return own(payload)
    return F.coalesce(own(payload), once(F.from_json(F.get_json_object(payload, "$.parts"), "array<string>"), below))


def reply_text(body: Column, fallback: Column) -> Column:
    """What a reply says, at most 500 characters: entities decoded, the quoted thread gone unless nothing else is left."""
    said = once(body, lambda b: F.when(F.trim(b) != "", b))
    source = F.coalesce(said, F.when(F.trim(fallback) != "", fallback))
    shown = once(decode_entities(source), lambda clean: F.coalesce(once(strip_quoted(clean), lambda own: F.when(own != "", own)), F.trim(clean)))
    return F.coalesce(once(shown, snippet), F.lit("Reply received"))


def relative_label(at: Column, now: Column) -> Column:
    """Just now, minutes, hours or days ago, else month and day."""
    seconds = F.floor(F.unix_timestamp(now) - F.unix_timestamp(at))
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, ago(seconds / 60, "m"))
        .when(seconds < 86_400, ago(seconds / 3600, "h"))
        .when(seconds < 7 * 86_400, ago(seconds / 86_400, "d"))
        .otherwise(F.date_format(at, "MMM d"))
    )


def sql_string(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))


def quoted_string(value: Column) -> Column:
    """For languages that take a backslash before a quote."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

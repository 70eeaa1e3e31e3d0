"""Column builders for text, addresses, names and pages; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def has(column: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case; null and empty hold nothing."""
    return F.coalesce(column.rlike(f"(?i){pattern}"), F.lit(False))


def first_match(column: Column, rules: list[tuple[str, object]], default=None) -> Column:
    """The value of the first pattern that occurs."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(has(column, pattern), F.lit(value)).otherwise(out)
    return out


def joined(*columns: Column) -> Column:
    """Lower-cased parts with spaces between, without null and empty ones."""
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))


def collapse(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))


def normalize_domain(column: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(bare, "/.*$", "")


def is_domain(column: Column) -> Column:
    return has(column, fixed.DOMAIN_SYNTAX)


def domain_of_url(column: Column) -> Column:
    """Host without www; null for hosts that are nobody's site."""
    host = F.regexp_replace(F.regexp_extract(F.lower(column), r"^(?:https?://)?([^/:?#\s]+)", 1), r"^www\.", "")
    return F.when((host != "") & ~host.isin(fixed.BLOCKED_HOSTS), host)


def likely_company_domain(column: Column) -> Column:
    return F.coalesce((F.length(column) >= 4) & ~column.isin(fixed.BLOCKED_HOSTS) & ~column.rlike(r"\.(gov|mil|edu|ac)(\.[a-z]{2})?$"), F.lit(False))


def website_url(domain: Column) -> Column:
    return F.concat(F.lit("https://"), F.regexp_replace(domain, r"^www\.", ""))


def company_key(domain: Column, name: Column, country: Column) -> Column:
    """Domain, else name and country, else null."""
    clean = F.nullif(normalize_domain(domain), F.lit(""))
    named = F.nullif(F.lower(F.trim(name)), F.lit(""))
    return F.coalesce(clean, F.when(named.isNotNull(), F.concat(F.lit("name:"), named, F.lit("|country:"), F.coalesce(F.lower(F.trim(country)), F.lit("")))))


def contact_key(email: Column, profile: Column, company_id: Column, name: Column) -> Column:
    mail, link, named = (F.nullif(F.lower(F.trim(c)), F.lit("")) for c in (email, profile, name))
    return F.coalesce(mail, link, F.when(named.isNotNull() & company_id.isNotNull(), F.concat(F.lit("company:"), company_id, F.lit("|name:"), named)))


def first_name(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), 1)


def last_name(name: Column) -> Column:
    """All after the first word, or null."""
    parts = F.split(F.trim(name), r"\s+")
    return F.nullif(F.array_join(F.slice(parts, 2, 100), " "), F.lit(""))


def person_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), r"\s+", " "))


def email_ok(email: Column) -> Column:
    clean = F.lower(F.trim(email))
    return F.coalesce((clean != "") & (F.length(clean) <= 254) & clean.rlike(fixed.EMAIL_SYNTAX), F.lit(False))


def email_problem(email: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return F.when(clean == "", "Email is empty.").when(F.length(clean) > 254, "Email exceeds maximum length.").when(~clean.rlike(fixed.EMAIL_SYNTAX), "Email format is invalid.")


def email_domain(email: Column) -> Column:
    """What follows the last @, if something stands before and after it."""
    return F.nullif(F.regexp_extract(F.lower(email), "^.+@([^@]+)$", 1), F.lit(""))


def email_guesses(name: Column, domain: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    first, last = clean(first_name(name)), clean(last_name(name))
    at = F.concat(F.lit("@"), domain)
    full = F.array(F.concat(first, at), F.concat(first, F.lit("."), last, at), F.concat(F.substring(first, 1, 1), F.lit("."), last, at), F.concat(first, last, at))
    return F.array_distinct(F.when(last != "", full).otherwise(F.array(F.concat(first, at))))


def is_placeholder(email: Column) -> Column:
    clean = F.lower(F.trim(email))
    return F.coalesce(~clean.contains("@") | has(clean, "(" + "|".join(fixed.PLACEHOLDER_EMAILS) + ")"), F.lit(True))


def profile_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), "linkedin\\.com/in/([a-z0-9-]+)", 1), F.lit(""))


def company_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), "linkedin\\.com/company/([a-z0-9-]+)", 1), F.lit(""))


def profile_url(url: Column) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/in/"), profile_slug(url))


def employee_count(text: Column) -> Column:
    """The middle of a range, rounded up at halves; else a count; null without either, or for zero."""
    number = r"(\d{1,3}(?:,\d{3})*)"
    plain = lambda c: F.regexp_replace(c, ",", "").try_cast("int")
    low, high = (plain(F.nullif(F.regexp_extract(text, rf"(?i){number}\s*[-–]\s*{number}\s*employees", g), F.lit(""))) for g in (1, 2))
    one = plain(F.nullif(F.regexp_extract(text, rf"(?i){number}\+?\s*employees?\b", 1), F.lit("")))
    staff = plain(F.nullif(F.regexp_extract(text, rf"(?i){number}\+?\s*(staff|people|team members)\b", 1), F.lit("")))
    middle = F.when((low > 0) & (high > 0), F.floor((low + high) / 2 + 0.5).cast("int"))
    return F.coalesce(middle, F.when(one > 0, one), F.when(one.isNull() & (staff > 0), staff))


def employee_band(count: Column) -> Column:
    out = F.when(count.isNotNull(), "5,000+")
    for most, label in reversed(fixed.EMPLOYEE_BANDS):
        out = F.when(count <= most, label).otherwise(out)
    return out


def location(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Each {{name}} by its value, in order."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


# fixed values: entities of mail texts, and where a quoted thread begins, in the order in which it is looked for
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " "}
QUOTED_THREADS = [r"\s+On\s+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+[\s\S]+?\s+wrote:\s*", r"\s+On\s+[\s\S]+?\s+wrote:\s*", r"\n-{3,}\s*Original Message\s*-{3,}", r"\nFrom:\s*.+\nSent:", r"\n_{3,}"]


def once(value: Column, then) -> Column:
    """then(value), with the value worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.regexp_replace(text, f"(?i){entity}", char)
    return text


def strip_quoted(text: Column) -> Column:
    """The text before the quoted thread that the first fitting pattern finds, without lines that begin with >."""

    def before(clean: Column) -> Column:
        places = [once(F.regexp_instr(clean, F.lit(f"(?i){pattern}")), lambda place: F.when(place > 1, place)) for pattern in QUOTED_THREADS]
        return once(F.coalesce(*places), lambda cut: F.when(cut.isNotNull(), F.substring(clean, F.lit(1), cut - 1)).otherwise(clean))

    own = once(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""), before)
    lines = F.filter(F.split(own, "\n"), lambda line: ~F.ltrim(line).startswith(">"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def snippet(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…")))


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def emails_in(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), F.lit(1)))
    return F.filter(found, lambda e: ~F.lower(e).rlike(r"example\.com|sentry|\.png$|\.jpg$"))


def phones_in(text: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"((?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4})"), F.lit(1)), lambda p: F.trim(p)))
    return F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 8)


def technologies_in(html: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(html, pattern), name) for name, pattern in fixed.TECHNOLOGY_SIGNS.items()]))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))


def paths_in(html: Column) -> Column:
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(/[^"#?]*)"'), F.lit(1)))
    return F.filter(links, lambda p: (F.length(p) <= 120) & ~p.rlike(r"(?i)\.(png|jpe?g|gif|svg|css|js|pdf|zip|ico)$"))


def is_shell(html: Column) -> Column:
    """A page that needs a browser: hardly any markup, or a framework's frame around hardly any text."""
    frame = html.rlike(r'(?i)__NEXT_DATA__|id="root"|id="app"|ng-version|data-reactroot|window\.__NUXT__|enable javascript|<app-root')
    return (F.length(html) < 200) | (frame & (F.length(html_text(html)) < 120))

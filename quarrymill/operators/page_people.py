"""People and metadata of company pages, from the table of their elements.

Each rule names elements that may stand for a person: where the name is, where the title, and the element around them (the
context) whose text and links belong to the person.  All rules are one pass over the elements with their siblings; then
contexts meet their own row, and what is first below them, by two joins.  Of people with the same name and title on a page
the first counts, by rule, then by place.

Text is what stands between the tags, without line breaks of its own: lines are those of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions import pages as P
from ..functions.relevance import plausible_name
from ..functions.text import domain_of_url, has
from ..sources.staging import staged
from .html_nodes import ancestors, attribute, closest, elements_of, kind, nodes

C = F.col
# fixed values: classes of people, of teams, of what holds a name, a title or a role, and lines of a card that are no title
CARDS = r"team-member|team_member|staff-member|person-card|profile-card|member-card|employee|leadership|our-team|staff"
TEAMS = r"team|people|leadership|staff|about"
CARD_NAMES = r"team-card__name|member-name|profile-name"
CARD_TITLES = r"team-card__title|member-title|profile-title|job-title"
ROLES = r"qualification|job-title|position"
SIBLING_ROLES = r"qualification|title|role"
NO_CARD_TITLES = r"^(view bio|read more|contact)$"
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
NOBODY = "Team Member"
HEADINGS = ["h2", "h3", "h4", "h5"]
#: Rows of pages meet by sorting: their files are so much smaller than they are that the size check would send them whole through the driver.
BY_SORTING = "merge"

_SAID = "struct<part:int,name:string,title:string>"


def _profile(href: Column) -> Column:
    return F.coalesce(href.contains("linkedin.com/in"), F.lit(False))


def _mailbox(href: Column) -> Column:
    return F.nullif(F.trim(F.substring_index(F.regexp_replace(href, "(?i)^mailto:", ""), "?", 1)), F.lit(""))


def _with_siblings(tree: DataFrame) -> DataFrame:
    """The element that follows, and the first later one that may hold a role."""
    row = Window.partitionBy("page", "parent").orderBy("place")
    role = C("tag").isin("p", "span", "div", "h5", "h6") | has(kind(), SIBLING_ROLES)
    return tree.withColumns(
        {
            "next": F.lead(F.struct("node", "tag", "text")).over(row),
            "later": F.first(F.when(role, F.trim("text")), ignorenulls=True).over(row.rowsBetween(1, Window.unboundedFollowing)),
        }
    )


_TOLD = "struct<text:string,named:boolean,titled:boolean>"


def _told(text: Column) -> Column:
    """A text, whether it may be a name, and whether it may be a title: asked once, where the text is first met."""
    return F.struct(text.alias("text"), plausible_name(text).alias("named"), P.is_title(text).alias("titled"))


def _below(tree: DataFrame) -> DataFrame:
    """For each element that holds them: its first profile, mailbox, name and roles, and all titles and cells in order."""
    href, text = attribute("href"), F.trim("text")
    link = C("tag") == "a"
    links = {"profile": (link & _profile(href), href), "mailto": (link & F.coalesce(href.startswith("mailto:"), F.lit(False)), _mailbox(href))}
    texts = {"card_name": has(kind(), CARD_NAMES) | C("tag").isin("h2", "h3", "h4"), "headed": C("tag").isin(*HEADINGS, "strong") | has(kind(), "name"), "role": has(kind(), ROLES), "said": has(kind(), "title")}
    lists = {"titles": has(kind(), CARD_TITLES) & (text != ""), "cells": C("tag").isin("td", "th") & (text != "")}
    tests = {**{n: test for n, (test, _) in links.items()}, **texts, **lists}
    found = tree.select("page", "node", "path", text.alias("text"), *[value.alias(f"the_{n}") for n, (_, value) in links.items()], *[test.alias(n) for n, test in tests.items()])
    found = found.where(F.greatest(*map(C, tests))).withColumn("told", F.when(F.greatest(*map(C, [*texts, *lists])), _told(C("text"))))
    found = found.select("page", "node", F.explode(F.transform(ancestors(), lambda a: a["node"])).alias("context"), "told", *[f"the_{n}" for n in links], *tests)
    first = [F.min(F.when(C(n), F.struct("node", f"the_{n}")))[f"the_{n}"].alias(n) for n in links] + [F.min(F.when(C(n), F.struct("node", "told")))["told"].alias(n) for n in texts]
    many = [F.transform(F.array_sort(F.collect_list(F.when(C(n), F.struct("node", "told")))), lambda x: x["told"]).alias(n) for n in lists]
    return found.groupBy("page", "context").agg(*first, *many)


def _candidates(tree: DataFrame) -> DataFrame:
    """page, rule, node, part, context, name, title, profile: what each rule says of each element; null is to be found in the context."""
    leads, tag, text, href = C("leads"), C("tag"), F.trim("text"), attribute("href")
    heading, named = tag.isin(HEADINGS), C("named")
    follows = F.trim(C("next.text"))
    shown = F.trim(F.regexp_replace(follows, r"(?i)\bview bio\b", ""))
    block = ["div", "li", "article", "section"]
    nothing = F.lit(None).cast("string")

    def rule(number: int, test: Column, context: Column, name: Column = nothing, title: Column = nothing, profile: Column = nothing) -> Column:
        said = F.struct(F.lit(number).alias("rule"), context.alias("context"), name.alias("name"), title.alias("title"), profile.alias("profile"))
        return F.when(F.coalesce(test, F.lit(False)), said)

    mailed = (tag == "a") & href.startswith("mailto:")
    around = closest(lambda s: s["tag"].isin(*block, "tr") | has(s["kind"], "team|member|staff"))
    step = C("path")
    later = F.nullif(C("later"), F.lit(""))
    role = F.coalesce(later, F.lit("?below"))
    fits = later.isNull() | P.is_title(later) | (leads & (F.length(later) <= 80) & ~later.contains("."))
    rules = F.array(
        rule(2, has(kind(), "team-card"), C("node")),
        rule(3, mailed, around),
        rule(4, mailed, around, title=F.lit("?again"), profile=_mailbox(href)),
        rule(5, leads & tag.isin(*HEADINGS, "strong") & named, C("parent")),
        rule(6, leads & heading & named & C("next.tag").isin("p", "span", "div", "h4", "h5", "a", "button") & P.is_title(shown), C("parent"), text, shown),
        rule(7, has(kind(), CARDS), C("node")),
        rule(8, heading & named & F.exists(ancestors(), lambda s: has(s["kind"], TEAMS)) & C("next.tag").isin("p", "span", "div", "h3", "h4", "h5") & P.is_title(follows), C("parent")),
        rule(9, (tag == "tr") & F.exists(step, lambda s: s["tag"] == "table"), C("node")),
        rule(10, (tag == "dt") & named & F.exists(step, lambda s: s["tag"] == "dl"), F.when(C("next.tag") == "dd", C("next.node")), text),
        rule(11, tag.isin("h2", "h3", "h4") & named & fits, F.coalesce(closest(lambda s: s["tag"].isin(block)), C("parent")), text, role),
        rule(12, (tag == "a") & _profile(href), closest(lambda s: s["tag"].isin(block) | has(s["kind"], "team|member")), profile=href),
    )
    wanted = tag.isin(*HEADINGS, "strong", "tr", "dt", "a") | has(kind(), CARDS + "|team-card")
    few = tree.where(wanted).withColumn("named", plausible_name(text))
    return few.select("page", "leads", "domain", "node", "parent", F.explode(F.array_compact(rules)).alias("r")).select("page", "leads", "domain", "node", "parent", "r.*")


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))["text"]


def _people_of_candidates(candidates: DataFrame, tree: DataFrame) -> DataFrame:
    """page, rule, node, part, name, title, email, profile."""
    below = staged(_below(tree), "page-below")
    beside = below.select("page", C("context").alias("parent"), C("role").alias("beside"))
    contexts = candidates.select("page", "context").where(C("context").isNotNull()).distinct()
    lines = F.filter(F.transform(F.split("around", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    own = tree.select("page", C("node").alias("context"), C("text").alias("around"), "domain").join(contexts.hint(BY_SORTING), ["page", "context"])
    mails = F.filter(P.all_of(C("around"), EMAIL), lambda e: F.lower(e).contains(F.coalesce(C("domain"), F.lit(""))) & ~has(e, r"example\.com|sentry|\.png$|\.jpg$"))
    own = own.select("page", "context", _told(F.trim("around")).alias("whole"), F.transform(lines, _told).alias("lines"), mails.alias("written"))
    own, below, beside = own.hint(BY_SORTING), below.withColumnRenamed("profile", "linked").hint(BY_SORTING), beside.hint(BY_SORTING)
    df = candidates.drop("domain").join(own, ["page", "context"], "left").join(below, ["page", "context"], "left").join(beside, ["page", "parent"], "left")
    rule, leads, stated = C("rule"), C("leads"), C("title")
    some = lambda c: F.coalesce(C(c), F.array().cast(f"array<{_TOLD}>"))
    first_name = _first(some("lines"), lambda x: x["named"])
    headed = F.when(C("headed.named"), C("headed.text"))
    name = F.when(rule == 2, F.when(C("card_name.named"), C("card_name.text"))).when(rule == 9, F.when(F.size(some("cells")) >= 2, _first(some("cells"), lambda x: x["named"]))).when(rule.isin(4, 12), first_name).otherwise(F.coalesce(C("name"), first_name, headed))
    df = df.withColumn("name", name).where(C("name").isNotNull())
    other = lambda x: x["text"] != C("name")
    titled = _first(some("lines"), lambda x: other(x) & x["titled"])
    loose = _first(some("lines"), lambda x: other(x) & F.length(x["text"]).between(3, 72) & ~x["named"] & ~has(x["text"], P.NO_TITLE_LINES))
    card = _first(some("titles"), lambda x: x["titled"])
    any_card = _first(some("titles"), lambda x: F.length(x["text"]).between(3, 80) & ~x["named"] & ~has(x["text"], NO_CARD_TITLES))
    title = (
        F.when(rule == 2, F.coalesce(card, F.when(leads, any_card)))
        .when(rule == 4, _first(some("lines"), lambda x: x["titled"]))
        .when(rule == 9, _first(some("cells"), lambda x: other(x) & x["titled"]))
        .when(rule == 10, F.when(C("whole.titled"), C("whole.text")).when(C("said.titled"), C("said.text")))
        .when((rule == 11) & (stated == "?below"), F.when(C("beside.titled") | (leads & (F.length("beside.text") <= 80) & ~C("beside.text").contains(".")), F.nullif(C("beside.text"), F.lit(""))))
        .when(rule.isin(6, 11), stated)
        .when(rule == 12, titled)
        .otherwise(F.coalesce(titled, F.when(leads, loose)))
    )
    df = df.withColumn("title", title).where((rule != 11) | C("title").isNotNull())
    raw = F.when(rule == 4, C("profile"))
    mailto = F.coalesce(raw, F.when(rule != 12, C("mailto")))
    written = F.when(rule == 4, F.array().cast("array<string>")).otherwise(F.coalesce("written", F.array().cast("array<string>")))
    df = df.select("page", F.when(rule == 4, 3).otherwise(rule).alias("rule"), "node", rule.alias("part"), "name", F.coalesce("title", F.lit(NOBODY)).alias("title"), contacts.best_email(mailto, written, C("name")).alias("email"), F.when(rule == 12, C("profile")).otherwise(C("linked")).alias("profile"), raw.alias("raw"))
    # a linked mailbox is looked at once more unless someone found so far has it
    before = Window.partitionBy("page").orderBy("rule", "node", "part").rowsBetween(Window.unboundedPreceding, -1)
    again = df.withColumn("known", F.array_contains(F.collect_set("email").over(before), C("raw")))
    return again.where(C("raw").isNull() | ~C("known")).drop("raw", "known")


def _json_people(tree: DataFrame) -> DataFrame:
    """People that a page's JSON-LD states: nodes of a list, or the one node."""
    raw = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    scripts = tree.where((C("tag") == "script") & (attribute("type") == "application/ld+json"))
    each = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = scripts.select("page", "node", F.posexplode(each).alias("part", "json"))
    get = lambda path: F.get_json_object("json", path)
    title = F.coalesce(get("$.jobTitle"), get("$.title"))
    profile = F.get(P.all_of(get("$.sameAs"), r"([^\s\"',\[\]]*linkedin\.com/in/[^\s\"',\[\]]*)"), F.lit(0))
    rows = rows.where(get("$['@type']").rlike("(?i)Person|Employee")).withColumn("name", F.trim(get("$.name"))).where(plausible_name(C("name")))
    return rows.select("page", F.lit(1).alias("rule"), "node", "part", "name", F.coalesce(F.when(P.is_title(title), title), F.lit(NOBODY)).alias("title"), contacts.personal_email(get("$.email"), C("name")).alias("email"), profile.alias("profile"))


def press_people(tree: DataFrame) -> DataFrame:
    """People of news pages: bold "Name, Title", said Name, Title, and both in running text; of a name the first counts."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[’]", "'"), "[“”]", '"'), r"\s+", " "))
    bold = C("tag").isin("b", "strong") & F.exists(ancestors(), lambda s: s["tag"].isin("p", "li", "a", "h3", "h4"))
    line = F.regexp_replace(plain, r":\s*$", "")
    empty = F.array().cast("array<struct<name:string,title:string>>")
    by_line = F.array(F.struct(F.regexp_extract(line, P.NAME_AND_TITLE, 1).alias("name"), F.regexp_extract(line, P.NAME_AND_TITLE, 2).alias("title")))
    said = F.transform(F.arrays_zip(P.all_of(plain, P.SAID, 1).alias("name"), P.all_of(plain, P.SAID, 2).alias("title")), lambda p: F.struct(F.trim(p["name"]).alias("name"), F.regexp_replace(F.trim(p["title"]), r"(?i)\s+(said|noted|added)$", "").alias("title")))
    running = F.arrays_zip(P.all_of(plain, P.IN_TEXT, 1).alias("name"), P.all_of(plain, P.IN_TEXT, 2).alias("title"))
    kind_ = "array<struct<name:string,title:string>>"
    found = F.when(bold, by_line.cast(kind_)).when(C("tag").isin("p", "li"), said.cast(kind_)).when(C("is_body"), running.cast(kind_)).otherwise(empty)
    rank = F.when(bold, 13).when(C("tag").isin("p", "li"), 14).otherwise(15)
    rows = tree.where(bold | C("tag").isin("p", "li") | C("is_body")).select("page", rank.alias("rule"), "node", F.posexplode(found).alias("part", "p")).select("page", "rule", "node", "part", F.trim(C("p.name")).alias("name"), F.trim(C("p.title")).alias("title"))
    rows = rows.where(((C("rule") == 15) | has(C("title"), P.EXECUTIVE)) & plausible_name(C("name")))
    first = F.row_number().over(Window.partitionBy("page", F.lower("name")).orderBy("rule", "node", "part"))
    nobody = F.lit(None).cast("string")
    return rows.withColumn("nth", first).where("nth = 1").select("page", "rule", "node", "part", "name", "title", nobody.alias("email"), nobody.alias("profile"))


def tree_of(pages: DataFrame) -> DataFrame:
    """pages: page, html, url.  The elements, with what the page's address says; is_body: the element that holds the text.

    Pages are read once and the elements written: what asks for people reads them several times."""
    told = pages.select("page", P.lists_people(C("url")).alias("leads"), P.tells_news(C("url")).alias("news"), domain_of_url(C("url")).alias("domain"))
    body = F.min(F.when(C("tag") == "body", C("node"))).over(Window.partitionBy("page"))
    tree = nodes(pages).withColumn("is_body", C("node") == F.coalesce(body, F.lit(0)))
    return staged(tree.join(told.hint(BY_SORTING), "page"), "page-tree")


def people(pages: DataFrame) -> DataFrame:
    """page, people (in order, array of struct(name, title, email, profile)); pages without people have an empty array."""
    tree = tree_of(pages)
    found = _people_of_candidates(staged(_candidates(_with_siblings(tree)), "page-candidates"), tree)
    found = found.unionByName(_json_people(tree)).unionByName(press_people(tree.where("news")))
    slug = F.lower(F.regexp_extract(F.coalesce("profile", F.lit("")), r"(?i)linkedin\.com/in/([a-z0-9_%-]+)", 1))
    found = found.withColumn("profile", F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/in/"), slug)))
    person = F.struct("rule", "node", "part", "name", "title", "email", "profile")
    once = found.groupBy("page", F.lower("name").alias("n"), F.lower("title").alias("t")).agg(F.min(person).alias("p"))
    ordered = once.groupBy("page").agg(F.array_sort(F.collect_list("p")).alias("people"))
    listed = F.transform("people", lambda p: F.struct(p["name"].alias("name"), p["title"].alias("title"), p["email"].alias("email"), p["profile"].alias("profile")))
    none = F.array().cast("array<struct<name:string,title:string,email:string,profile:string>>")
    return pages.select("page").join(ordered.hint(BY_SORTING), "page", "left").select("page", F.coalesce(listed, none).alias("people"))


def metadata(pages: DataFrame) -> DataFrame:
    """page, title, description, linkedin, twitter, facebook: the first element of each kind that says it."""
    tree = elements_of(pages, ["meta", "title", "p", "a"])
    tag, named = lambda e, name: e["tag"] == name, lambda e, name: e["attributes"][name]
    text = lambda e: F.trim(F.regexp_replace(e["text"], r"^\s+|\s+$", ""))
    said = lambda key, value: (lambda e: tag(e, "meta") & (named(e, key) == value), lambda e: F.trim(named(e, "content")))
    link = lambda host: (lambda e: tag(e, "a") & named(e, "href").contains(host), lambda e: named(e, "href"))
    plain = lambda name: (lambda e: tag(e, name), text)
    marks = {"site": said("property", "og:site_name"), "titled": plain("title"), "told": said("name", "description"), "open": said("property", "og:description"), "paragraph": plain("p"), "linkedin": link("linkedin.com/company"), "twitter": link("twitter.com"), "x": link("x.com"), "facebook": link("facebook.com")}
    first = tree.select(C("page").cast(pages.schema["page"].dataType), *[value(F.get(F.filter("found", test), F.lit(0))).alias(n) for n, (test, value) in marks.items()])
    some = lambda c: F.nullif(c, F.lit(""))
    return first.select("page", F.coalesce(some(C("site")), some(C("titled"))).alias("title"), F.coalesce(some(C("told")), some(C("open")), some(F.substring("paragraph", 1, 280))).alias("description"), "linkedin", F.coalesce("twitter", "x").alias("twitter"), "facebook")

"""Queries over pages of companies, on stated pages and on the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import pages as P
from ..operators import html_nodes, site_paths
from ..operators import page_people as people
from ..registry import query
from ..sources import model
from ..sources.cases import case_query
from ..sources.staging import spread

C = F.col

_TEAM = "https://acme.example/team"
_PEOPLE = [  # page, address, people
    (
        '<script type="application/ld+json">[{"@type":"Person","name":"Jane Doe","jobTitle":"CEO","email":"jane.doe@acme.example","sameAs":["https://x.example","https://www.linkedin.com/in/Jane-Doe"]},{"@type":"Thing","name":"Bob Roe"},{"@type":"Employee","name":"Our Mission"}]</script>'
        '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"Person","name":"Ann Poe","title":"Painter"}</script>',
        "https://acme.example/",
        "Jane Doe|CEO|jane.doe@acme.example|https://www.linkedin.com/in/jane-doe;Ann Poe|Team Member|-|-",
    ),
    # lines are those of the source: without a break the link's block is one line, which passes for a name
    ('<section><div class="team-card"><h3 class="team-card__name">Jane Doe</h3><p class="team-card__title">Chief of Staff</p><a href="https://linkedin.com/in/jdoe">in</a></div></section>', "https://acme.example/", "Jane Doe|Chief of Staff|-|https://www.linkedin.com/in/jdoe;Jane DoeChief of Staffin|Team Member|-|https://www.linkedin.com/in/jdoe"),
    ('<ul><li>Jane Doe\n<br>Managing Director\n<br><a href="mailto:jane@acme.example?subject=x">mail</a></li><li>open 24/7 <a href="mailto:info@acme.example">mail</a></li></ul>', "https://acme.example/", "Jane Doe|Managing Director|jane@acme.example|-"),
    ("<div><h3>Jane Doe</h3><p>Keeper of 100 keys</p></div>", _TEAM, "Jane Doe|Jane DoeKeeper of 100 keys|-|-;Jane Doe|Keeper of 100 keys|-|-"),
    ("<div>\n<h3>Jane Doe</h3>\n<p>Keeper of 100 keys</p>\n</div>", _TEAM, "Jane Doe|Keeper of 100 keys|-|-"),
    ("<div><h3>Jane Doe</h3><p>Keeper of 100 keys</p></div>", "https://acme.example/shop", ""),
    ('<div class="staff-member"><span>Jane Doe</span>\n<span>VP Sales</span></div>', "https://acme.example/", "Jane Doe|VP Sales|-|-"),
    ("<table><tr><th>#1<th>#2<tr><td>Jane Doe<td>Chairman<tr><td>Bob Roe<td>Gardener</table>", "https://acme.example/", "Jane Doe|Chairman|-|-;Bob Roe|Team Member|-|-"),
    ("<dl><dt>Jane Doe</dt><dd>Founder</dd><dt>Bob Roe<dd>Cook<dt>Read more</dt><dd>CEO</dd></dl>", "https://acme.example/", "Jane Doe|Founder|-|-;Bob Roe|Cook|-|-"),
    ("<article><h4>Jane Doe</h4><span>Head of Growth</span></article>", "https://acme.example/", "Jane Doe|Head of Growth|-|-"),
    ('<div><span>Jane Doe</span>\n<a href="https://linkedin.com/in/jd-1">profile</a></div>', "https://acme.example/", "Jane Doe|Team Member|-|https://www.linkedin.com/in/jd-1"),
    ("<p><b>Jane Doe, Vice President of Sales</b>: hello</p><p>We win, said Bob Roe, chief executive officer.</p><p>Ann Poe, CTO was there.</p>", "https://acme.example/news/win", "Jane Doe|Vice President of Sales|-|-;Bob Roe|chief executive officer|-|-;Ann Poe|CTO|-|-"),
    ('<article><h4>Jane Doe</h4><span>Head of Growth</span></article><div class="staff"><p>Jane Doe</p>\n<p>Head of Growth</p></div>', "https://acme.example/", "Jane Doe|Head of Growth|-|-"),
    # name and title in different blocks, beside each other
    ('<section class="about"><div><h3>Jane Doe</h3></div>\n<div>CEO &amp; Founder</div></section><section class="team">\n<h4>Nils Berg</h4>\n<p>CEO &amp; Founder</p>\n</section>', "https://acme.example/", "Nils Berg|CEO & Founder|-|-"),
    ("<div><h3>Jane Doe</h3><img><i>of us</i><div>Managing Director</div></div>", "https://acme.example/", "Jane Doe|Managing Director|-|-"),
    ('<li><h3>Jane Doe</h3><i><span class="qualification">CEO, MBBS</span></i></li>', "https://acme.example/", "Jane Doe|CEO, MBBS|-|-"),
    # a mailbox that is nobody's own gives the person once more, without the loose title
    ('<div>Jane Doe\nKeeper of 100 keys\n<a href="mailto:info@acme.example">mail</a></div>', _TEAM, "Jane Doe|Keeper of 100 keys|-|-;Jane Doe|Team Member|-|-"),
    (None, None, ""),
]


def _by_page(df, told):
    return {"_df": told.withColumnRenamed("page", "id")} | {c: C(c) for c in told.columns if c != "page"}


def _people(df):
    told = people.people(df.select(C("id").alias("page"), "html", "url"))
    return {"_df": told.withColumnRenamed("page", "id"), "people": P.as_text(C("people"))}


case_query("HTM5_people_on_page", {"html": [p[0] for p in _PEOPLE], "url": [p[1] for p in _PEOPLE]}, _people, {"people": [p[2] for p in _PEOPLE]})

_WHO = "'Jane ' || upper(substr(translate(lpad(c_custkey::VARCHAR, 6, '0'), '0123456789', 'abcdefghij'), 1, 1)) || substr(translate(lpad(c_custkey::VARCHAR, 6, '0'), '0123456789', 'abcdefghij'), 2)"
_ROLES = {"AUTOMOBILE": "Chief Executive Officer", "BUILDING": "Head of Growth", "FURNITURE": "Sales Director", "HOUSEHOLD": "VP Engineering", "MACHINERY": "Managing Director"}


@query(
    "HTM5_people_of_companies",
    f"SELECT c_custkey AS id, {_WHO} AS name, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items())} ELSE 'Owner' END AS title, CASE WHEN c_custkey % 4 = 0 THEN lower(replace({_WHO}, ' ', '.')) || '@acme.example' END AS email FROM customer",
)
def people_of_companies(spark, sf_dir):
    """A page a company in one of four layouts, read back: a card with a linked mailbox, siblings, a table, a definition list."""
    key = C("c_custkey")
    letters = F.translate(F.lpad(key.cast("string"), 6, "0"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("Jane "), F.upper(F.substring(letters, 1, 1)), F.substring(letters, 2, 9))
    title = F.coalesce(*[F.when(C("c_mktsegment") == k, v) for k, v in _ROLES.items()], F.lit("Owner"))
    email = F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit("@acme.example"))
    layouts = ["<div class='team-card'>\n<h3 class='team-card__name'>%s</h3>\n<p class='team-card__title'>%s</p>\n<a href='mailto:%s'>mail</a></div>", "<main><h3>%s</h3><img src=x><p>%s</p></main>", "<table><tr><th>#1<th>#2<tr><td>%s<td>%s</table>", "<dl><dt>%s<dd>%s</dl>"]
    html = F.element_at(F.array(*[F.format_string(x, name, title, email) for x in layouts]), (key % 4 + 1).cast("int"))
    pages = spread(model.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(key.alias("page"), html.alias("html"), F.lit("https://acme.example/").alias("url"))
    found = people.people(pages).select(C("page").alias("id"), F.explode("people").alias("p"))
    return found.select("id", "p.name", "p.title", "p.email")


_META = [  # page, title, description, profile links
    ('<meta content="Acme" property="og:site_name"><title>Home</title><meta name="description" content=" We build robots. "><a href="https://www.linkedin.com/company/acme">in</a><a href="https://x.com/acme">x</a>', "Acme", "We build robots.", "https://www.linkedin.com/company/acme", "https://x.com/acme", None),
    ('<title> Acme Home </title><meta property="og:description" content="Robots"><p>No</p><a class="f" href="https://facebook.com/acme">f</a><a href="https://twitter.com/acme">t</a>', "Acme Home", "Robots", None, "https://twitter.com/acme", "https://facebook.com/acme"),
    ("<title></title><p>First <b>words</b> of us<p>second</p>", None, "First words of us", None, None, None),
    (None, None, None, None, None, None),
]
case_query("HTM4_metadata", {"html": [m[0] for m in _META]}, lambda df: _by_page(df, people.metadata(df.select(C("id").alias("page"), "html"))), {c: [m[i + 1] for m in _META] for i, c in enumerate(("title", "description", "linkedin", "twitter", "facebook"))})


def _pages(spark, sf_dir):
    return spread(model.table(spark, sf_dir, "pages").select(C("page_id").alias("page"), "html"), "page", 4_000)


_PLAIN = "regexp_replace(replace(replace(regexp_replace({0}, '&quot;?', '\"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"
_BARE = "regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs')"


@query("HTM4_page_metadata", f"SELECT page_id, {_PLAIN.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))")} AS title, trim(substr(trim({_PLAIN.format(f"regexp_replace(regexp_extract({_BARE}, '<p>(.*?)(<p>|</p>|</article>)', 1, 's'), '<[^>]*>', '', 'g')")}, ' ' || chr(10)), 1, 280)) AS description FROM pages")
def page_metadata(spark, sf_dir):
    """Title and first paragraph of the pages as they are."""
    told = people.metadata(_pages(spark, sf_dir))
    return told.select(C("page").alias("page_id"), "title", F.trim("description").alias("description"))


_COUNTED = {"p": "p", "li": "li", "a": "a", "article": "article", "br": "br"}


@query("HTM5_page_elements", f"SELECT page_id, {', '.join(f"len(regexp_extract_all({_BARE}, '<{t}[ >]'))::BIGINT AS n_{t}" for t in _COUNTED)}, len(regexp_extract_all(regexp_extract({_BARE}, '<nav>(.*?)</nav>', 1, 's'), '<a '))::BIGINT AS nav_links FROM pages")
def page_elements(spark, sf_dir):
    """Elements of each page by tag, and the links below its navigation."""
    tree = html_nodes.nodes(_pages(spark, sf_dir))
    below = F.exists(html_nodes.ancestors(), lambda s: s["tag"] == "nav")
    return tree.groupBy(C("page").alias("page_id")).agg(*[F.count_if(C("tag") == t).alias(f"n_{t}") for t in _COUNTED], F.count_if((C("tag") == "a") & below).alias("nav_links"))


_LISTINGS = [  # page, name, website, phone, location, city, description, completeness
    ('<script type="application/ld+json">{"@type":"WebSite","name":"no"}</script><script type="application/ld+json">{"@graph":[{"@type":["Thing","LocalBusiness"],"name":{"name":"Acme"},"url":"https://acme.example","telephone":"123","address":{"streetAddress":"Main 1","addressLocality":"Berlin","postalCode":"10115","addressCountry":"DE"},"description":"short"}],"@type":"WebPage"}</script>', "Acme", "https://acme.example", "123", "Main 1, Berlin, 10115, DE", "Berlin", "short", 88),
    ('<script type="application/ld+json">[{"@type":"Organization"},{"@type":"Corporation","name":"Globex","address":"Somewhere 5","description":"A description that is certainly longer than forty characters"}]</script>', "Globex", None, None, "Somewhere 5", None, "A description that is certainly longer than forty characters", 65),
    ('<script type="application/ld+json">{broken</script>', None, None, None, None, None, None, 20),
    (None, None, None, None, None, None, None, 20),
]
_FIELDS = ("name", "website", "phone", "location", "city", "description")


def _listing(df):
    df = df.withColumn("o", P.organisation(C("html")))
    score = P.listing_completeness(F.coalesce(C("o.name"), F.lit("fallback")), C("o.website"), C("o.phone"), C("o.location"), C("o.description"), F.lit(2))
    return {"_df": df, **{c: C(f"o.{c}") for c in _FIELDS}, "completeness": F.when(C("o.name").isNotNull(), score).otherwise(F.lit(20))}


case_query("HTM7_organisation", {"html": [x[0] for x in _LISTINGS]}, _listing, {**{c: [x[i + 1] for x in _LISTINGS] for i, c in enumerate(_FIELDS)}, "completeness": [x[7] for x in _LISTINGS]})

_PRESS = [
    ("<p><b>Jane Doe, Vice President of Sales</b>: hello</p><li><strong>Bob Roe, gardener</strong></li>", "Jane Doe|Vice President of Sales|-|-"),
    ('<p>"Great," said Dr. Jane Doe, chief robot officer. More.</p><p>said Bob Roe, owner "and so on"</p>', "Dr. Jane Doe|chief robot officer|-|-;Bob Roe|owner|-|-"),
    ("<div>Ann Poe, Managing Director and Jane Doe, Chief Financial Officer met. Ann Poe, CEO</div>", "Ann Poe|Managing Director|-|-;Jane Doe|Chief Financial Officer|-|-"),
    ("<p><b>Sean O&rsquo;Hara, Vice President</b>: Sean</p><p>&ldquo;Proud,&rdquo; said Tom P. Lund, Acme President.</p>", "Sean O'Hara|Vice President|-|-;Tom P. Lund|Acme President|-|-"),
    ("<p>Nobody here</p>", ""),
    (None, ""),
]


def _press(df):
    pages = df.select(C("id").alias("page"), "html", F.lit("https://acme.example/news/1").alias("url"))
    found = people.press_people(people.tree_of(pages)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("rule", "node", "part", "name", "title", "email", "profile"))).alias("people"))
    none = F.array().cast(found.schema["people"].dataType)
    return {"_df": pages.join(found.hint(people.BY_SORTING), "page", "left").withColumnRenamed("page", "id"), "people": P.as_text(F.coalesce("people", none))}


case_query("HTM8_press_people", {"html": [p[0] for p in _PRESS]}, _press, {"people": [p[1] for p in _PRESS]})

_ANSWERS = [
    ('Here: ```json\n[{"fullName":"Jane Doe","title":"CEO","email":" "},{"name":"jane doe","jobTitle":"ceo"},{"name":"Bob Roe","email":"bob@acme.example"},{"name":"X"}]\n``` done', "Jane Doe|CEO|-|-;Bob Roe|Team Member|bob@acme.example|-"),
    ("[" + ",".join(f'{{"name":"Person {chr(65 + i)}"}}' for i in range(14)) + "]", ";".join(f"Person {chr(65 + i)}|Team Member|-|-" for i in range(12))),
    ("no list", ""),
    ("[broken", ""),
    (None, ""),
]
case_query("HTM11_people_of_answer", {"answer": [a for a, _ in _ANSWERS]}, lambda df: {"people": P.as_text(P.people_of_answer(C("answer")))}, {"people": [p for _, p in _ANSWERS]})

_HOST = "regexp_extract(lower(url), '^(?:https?://)?([^/:?#\\s]+)', 1)"
_LINK = fixed.DIRECTORY_LINK
_SKIPPED = r"\.(pdf|zip|png|jpg|jpeg|gif|svg|css|js)$"
_USUAL = ", ".join(f"('{p}', {i})" for i, p in enumerate(["", *fixed.LEADERSHIP_PATHS, *fixed.CONTACT_PATHS]))


@query(
    "HTM10_site_paths",
    f"""WITH fronts AS (SELECT page_id, {_HOST} AS host, {_BARE} AS bare FROM pages WHERE html IS NOT NULL),
 links AS (SELECT page_id, unnest(l) AS path, generate_subscripts(l, 1) AS nth FROM (SELECT page_id, regexp_extract_all(bare, '<a href="(/[^"]*)"', 1) AS l FROM fronts)),
 home AS (SELECT page_id, 1 AS part, nth, path FROM (SELECT page_id, nth, regexp_replace(regexp_replace(path, '[?#].*$', ''), '/$', '') AS path FROM links) WHERE path <> '' AND length(path) <= 120 AND NOT regexp_matches(path, '{_SKIPPED}', 'i') AND regexp_matches(path, '{_LINK}', 'i')),
 mapped AS (SELECT page_id, 2 AS part, 1 AS nth, '/Team' AS path FROM fronts UNION ALL SELECT page_id, 2, 2, '/news/' || page_id FROM fronts WHERE page_id % 3 = 0),
 every AS (SELECT * FROM home UNION ALL SELECT * FROM mapped UNION ALL SELECT page_id, CASE WHEN u.path = '' THEN 0 ELSE 3 END, nth, u.path FROM fronts, (VALUES {_USUAL}) u(path, nth)),
 once AS (SELECT page_id, arg_min(path, part * 1000000 + nth) AS path, min(part * 1000000 + nth) AS ord FROM every GROUP BY page_id, lower(path))
 SELECT page_id, place::INTEGER AS place, 'https://' || regexp_replace(host, '^www\\.', '') || path AS url FROM (SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS place FROM once) JOIN fronts USING (page_id) WHERE place <= {22 + len(fixed.LEADERSHIP_PATHS)}""",
)
def paths_of_sites(spark, sf_dir):
    """Where people may stand on each page's site: its links, a sitemap with other hosts, files and doubles, and the usual paths."""
    rows = model.table(spark, sf_dir, "pages").where(C("html").isNotNull())
    fronts = rows.select(C("page_id").alias("page"), F.regexp_extract(F.lower("url"), r"^(?:https?://)?([^/:?#\s]+)", 1).alias("host"), "html")
    at = lambda path: F.concat(F.lit("<url><loc> https://"), C("host"), path, F.lit(" </loc></url>"))
    news = F.when(C("page") % 3 == 0, at(F.concat(F.lit("/news/"), "page", F.lit("/?x=1")))).otherwise("")
    xml = F.concat(F.lit("<urlset>"), at(F.lit("/")), at(F.lit("/Team/")), F.lit("<url><loc>https://elsewhere.example/team</loc></url>"), at(F.lit("/board.pdf")), at(F.lit("/shop")), news, F.lit("</urlset>"))
    return site_paths.site_paths(fronts, fronts.select("page", xml.alias("xml"))).select(C("page").alias("page_id"), "place", "url")

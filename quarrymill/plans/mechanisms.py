"""Queries over what spans rows: closures, text against terms, spelling, JSON trees, stored tables, providers, timed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure as closures
from ..operators import json_tree, term_search
from ..registry import query
from ..sources import model, providers
from ..sources.staging import new_folder, spread
from ..sources.stored import StoredTable
from ..streaming import timers

C = F.col


@query(
    "SRC8_class_closure",
    """WITH RECURSIVE edges AS (SELECT DISTINCT p_partkey AS child, p_partkey // 4 + p_size % 3 AS parent FROM part),
 reached AS (SELECT p_partkey AS root, p_partkey AS node FROM part WHERE p_type = 'PROMO' UNION SELECT root, child FROM reached JOIN edges ON node = parent)
 SELECT root, count(*) AS kinds, max(node) AS last FROM reached GROUP BY root""",
)
def class_closure(spark, sf_dir):
    """All kinds below each class of one type; a part is a kind of the part that its key and size name, in circles too."""
    part = model.table(spark, sf_dir, "part")
    key = C("p_partkey")
    edges = part.select(key.alias("child"), (F.floor(key / 4) + C("p_size") % 3).alias("parent"))
    found = closures.closure(edges, part.where("p_type = 'PROMO'").select(key.alias("root"), key.alias("node")))
    return found.groupBy("root").agg(F.count("*").alias("kinds"), F.max("node").alias("last"))


_WORDS = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    "JN11_term_mentions",
    f"""WITH terms AS (SELECT 'item ' || item_id AS term_id, array_to_string(string_split({_WORDS.format("text")}, ' ')[1:3], ' ') AS term FROM benchmark
  UNION ALL SELECT 'part ' || min(p_partkey), {_WORDS.format("p_name")} FROM part GROUP BY p_name UNION ALL SELECT 'word ' || s_suppkey, ['the', 'and', 'of the', 'der', 'les'][s_suppkey % 5 + 1] FROM supplier WHERE s_suppkey < 5),
 texts AS (SELECT doc_id, ' ' || {_WORDS.format("coalesce(text, '')")} || ' ' AS t FROM documents)
 SELECT doc_id, term_id FROM texts JOIN terms ON contains(t, ' ' || term || ' ')""",
)
def term_mentions(spark, sf_dir):
    """Whole documents against a table of terms: starts of the benchmark's items, names of parts, some frequent words."""
    read = lambda name: model.table(spark, sf_dir, name)
    starts = read("benchmark").select(F.concat(F.lit("item "), "item_id").alias("term_id"), F.array_join(F.slice(F.split(term_search.words(C("text")), " "), 1, 3), " ").alias("term"))
    parts = read("part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("part "), "k"), "p_name")
    key = C("s_suppkey")
    few = read("supplier").where(key < 5).select(F.concat(F.lit("word "), key), F.element_at(F.array(*map(F.lit, ("the", "and", "of the", "der", "les"))), (key % 5 + 1).cast("int")))
    texts = read("documents").select(C("doc_id").alias("text_id"), "text")
    return term_search.mentions(texts, starts.union(parts).union(few)).select(C("text_id").alias("doc_id"), "term_id")


_TYPED = "CASE o_orderkey % 4 WHEN 0 THEN 'Name ' || {0} WHEN 1 THEN 'nam ' || {0} WHEN 2 THEN 'Name ' || substr({0}, 1, 2) || substr({0}, 4) || 'x' ELSE 'xame ' || {0} END"
_CODE = "substr(md5((o_custkey // 7)::VARCHAR), 1, 7)"


@query(
    "STR27_spelled_names",
    f"""WITH typed AS (SELECT o_orderkey AS typed_id, lower({_TYPED.format(_CODE)}) AS typed FROM orders WHERE o_orderkey % 3 = 0),
 known AS (SELECT DISTINCT 'Name ' || substr(md5(c_custkey::VARCHAR), 1, 7) AS name FROM customer)
 SELECT typed_id, name, d::INTEGER AS distance FROM (SELECT *, row_number() OVER (PARTITION BY typed_id ORDER BY d, name) AS nth FROM (SELECT typed_id, name, levenshtein(typed, lower(name)) AS d FROM typed JOIN known ON substr(typed, 1, 2) = lower(substr(name, 1, 2)) AND length(name) BETWEEN length(typed) - 2 AND length(typed) + 2) WHERE d <= 2) WHERE nth = 1""",
)
def spelled_names(spark, sf_dir):
    """Words typed for each order, as known, misspelt or unknown, against the names of all customers."""
    key, code = C("o_orderkey"), F.substring(F.md5(F.floor(C("o_custkey") / 7).cast("string")), 1, 7)
    wrong = F.concat(F.lit("Name "), F.substring(code, 1, 2), F.substring(code, 4, 9), F.lit("x"))
    typed = F.when(key % 4 == 0, F.concat(F.lit("Name "), code)).when(key % 4 == 1, F.concat(F.lit("nam "), code)).when(key % 4 == 2, wrong).otherwise(F.concat(F.lit("xame "), code))
    known = model.table(spark, sf_dir, "customer").select(F.concat(F.lit("Name "), F.substring(F.md5(C("c_custkey").cast("string")), 1, 7)).alias("name"))
    return term_search.spelled(model.table(spark, sf_dir, "orders").where(key % 3 == 0).select(key.alias("typed_id"), typed.alias("typed")), known)


@query("JSON_event_props", "SELECT event_type, json_extract(props, '$.k')::INTEGER % 10 AS digit, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark, sf_dir):
    """A field of the events' properties, by VARIANT; one that is missing or of another type is null."""
    props = F.try_parse_json("props")
    return model.table(spark, sf_dir, "events").groupBy("event_type", (F.try_variant_get(props, "$.k", "int") % 10).alias("digit")).agg(F.count("*").alias("n"))


@query(
    "HTM7_organisations_at_any_depth",
    """SELECT c_custkey AS id, '$.@graph[0]' AS path, c_name AS name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, '$.@graph[0].department.@graph[1]', 'Branch of ' || c_name, NULL FROM customer WHERE c_custkey % 2 = 0""",
)
def organisations_at_any_depth(spark, sf_dir):
    """Organisations of nested graphs, with their paths; every other page has a branch below its department."""
    customer = spread(model.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    tables = customer.join(model.table(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey"))
    branch = F.when(C("c_custkey") % 2 == 0, F.lit('[{"@type":"Thing","name":"x"},{"@type":["Thing","LocalBusiness"],"name":"Branch of %s"}]')).otherwise("[]")
    page = F.format_string('{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"%s","address":{"addressCountry":"%s"},"department":{"@graph":%s}},{"@type":"WebSite","name":"no"}]}', "c_name", "n_name", F.replace(branch, F.lit("%s"), C("c_name")))
    nodes = json_tree.json_nodes(tables.select(C("c_custkey").alias("id"), page.alias("json")))
    found = json_tree.typed_nodes(nodes, "^(Organization|LocalBusiness|Corporation|ProfessionalService)$")
    text = lambda json, path: F.get_json_object(F.concat(F.lit("["), json, F.lit("]")), path)
    return found.select("id", "path", text(C("fields")["name"], "$[0]").alias("name"), text(C("fields")["address"], "$[0].addressCountry").alias("country"))


@query("SNK1_stored_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, coalesce(a.seen, b.seen) AS seen FROM (SELECT c_custkey AS k, c_name AS name, 'old' AS seen FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_name || ' new' AS name, 'new' AS seen FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 35 <> 0) b ON a.k = b.k")
def stored_upsert(spark, sf_dir):
    """Customers in a stored table of buckets, changed by key; changes without a key and keys with several changes are rejected."""
    customer, key = model.table(spark, sf_dir, "customer"), C("c_custkey")
    rows = lambda seen, name: [key.alias("k"), name.alias("name"), F.lit(seen).alias("seen")]
    table = StoredTable(spark, new_folder(spark, "customers"), ["k"])
    table.create(customer.where(key % 3 != 0).select(*rows("old", C("c_name"))))
    new = customer.where(key % 5 == 0).select(*rows("new", F.concat("c_name", F.lit(" new"))))
    twice = customer.where(key % 35 == 0).select(*rows("new", F.concat("c_name", F.lit(" newer"))))
    table.upsert(new.union(twice).union(new.limit(3).withColumn("k", F.lit(None).cast("long"))), kept=["seen"])
    return table.read()


@query("SRC7_pages_by_provider", "SELECT page_id, url, length(html) AS size FROM pages WHERE page_id >= 20 AND page_id < 2000 AND html IS NOT NULL")
def pages_by_provider(spark, sf_dir):
    """Pages from a provider: two columns and a range of keys reach the reader, which opens only row groups that may hold them."""
    source = providers.provider({"provider": "Store", "path": f"{sf_dir}/pages.parquet", "store_key": "none"})
    return source.rows(spark).where("page_id >= 20 and page_id < 2000 and html is not null").select("page_id", "url", F.length("html").alias("size"))


@query("SRC9_hits_by_provider", "SELECT c_mktsegment AS segment, count(*) AS hits, min(c_custkey) AS first FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def hits_by_provider(spark, sf_dir):
    """People of two segments from the provider that is there when the one asked for is not configured."""
    source = providers.provider({"provider": "store", "path": f"{sf_dir}/customer.parquet"})
    return source.rows(spark).where(C("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(C("c_mktsegment").alias("segment")).agg(F.count("*").alias("hits"), F.min("c_custkey").alias("first"))


def _stream(spark, sf_dir):
    return spark.readStream.schema(model.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


_PAST = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query(
    "STM3_due_follow_ups",
    f"""WITH m AS (SELECT user_id AS person, event_id AS mail_id, date_trunc('millisecond', ts) AS at FROM events WHERE event_type = 'signup'), r AS (SELECT user_id AS person, date_trunc('millisecond', ts) AS at FROM events WHERE event_type = 'click'),
 first AS (SELECT mail_id, min(r.at) AS answer FROM m JOIN r ON m.person = r.person AND r.at > m.at AND r.at <= m.at + INTERVAL 3 HOUR GROUP BY mail_id)
 SELECT person, m.mail_id, CASE WHEN answer IS NULL THEN 'due' ELSE 'cancelled' END AS state, epoch_ms(coalesce(answer, m.at + INTERVAL 3 HOUR)) AS at_ms FROM m LEFT JOIN first USING (mail_id) WHERE m.at + INTERVAL 3 HOUR <= (SELECT max(w) - INTERVAL 10 MINUTE FROM (SELECT m.at AS w FROM m UNION ALL SELECT r.at FROM r))""",
)
def due_follow_ups(spark, sf_dir):
    """Sign-ups as mails and clicks as replies, in a stream with timers: what falls due, and what a reply cancels."""
    events = _stream(spark, sf_dir).select(C("user_id").alias("person"), C("event_id").alias("mail_id"), F.date_trunc("millisecond", C("ts").cast("timestamp")).alias("at"), "event_type")
    out = timers.follow_ups(events.where("event_type = 'signup'"), events.where("event_type = 'click'"), 3 * 3_600_000)
    found = timers.run_once(out, new_folder(spark, "follow-ups"), "person long, mail_id long, state string, at timestamp")
    return found.select("person", "mail_id", "state", F.unix_millis("at").alias("at_ms"))


@query(
    "STM6_expired_entries",
    f"SELECT user_id AS key, event_id AS entry, epoch_ms(w + INTERVAL 6 HOUR) AS at_ms FROM (SELECT *, lead(w) OVER (PARTITION BY user_id ORDER BY w, event_id) AS later FROM (SELECT user_id, event_id, date_trunc('millisecond', ts) AS w FROM events)) WHERE (later IS NULL OR later > w + INTERVAL 6 HOUR) AND w + INTERVAL 6 HOUR <= {_PAST}",
)
def expired_entries(spark, sf_dir):
    """A cache as a stream: entries whose time is over before another of their key comes."""
    writes = _stream(spark, sf_dir).select(C("user_id").alias("key"), C("event_id").alias("entry"), F.date_trunc("millisecond", C("ts").cast("timestamp")).alias("at"))
    found = timers.run_once(timers.expiries(writes, 6 * 3_600_000), new_folder(spark, "expiries"), "key long, entry long, expired_at timestamp")
    return found.select("key", "entry", F.unix_millis("expired_at").alias("at_ms"))


@query("STM8_new_keys", "SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def new_keys(spark, sf_dir):
    """Keys of the stream that are not known yet, each once."""
    rows = _stream(spark, sf_dir).select("user_id", "event_type", C("ts").cast("timestamp").alias("at"))
    known = model.table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(C("c_custkey").alias("user_id"))
    known = known.crossJoin(spark.createDataFrame([(t,) for t in ("signup", "click", "view", "error", "purchase")], "event_type string"))
    out = timers.new_keys(rows, known, ["user_id", "event_type"], "at").select("user_id", "event_type")
    return timers.run_once(out, new_folder(spark, "new-keys"), "user_id long, event_type string")

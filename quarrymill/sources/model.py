"""The prospecting model over the driver's tables: one DataFrame a table, and the same tables as SQL views.

Every table reads only the columns it needs; filters of callers reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import spread

TITLES = {"1-URGENT": "Chief Executive Officer", "2-HIGH": "CTO", "3-MEDIUM": "VP Engineering", "4-NOT SPECIFIED": "Office Manager", "5-LOW": "Co-Founder"}
#: What companies say of themselves, by key.
PHRASES = [
    "builds cloud software for hospitals and clinics. 51-200 employees",
    "is a hotel and resort group in Germany",
    "We are hiring. Series B funding round for our SaaS platform",
    "online store and fashion brand with 1,200 employees",
    "venture capital seed fund",
    "magazine publisher and broadcasting network",
    "machinery and automotive factory, about 80 staff",
    "digital agency for real estate. Expanding to new office",
    "fintech payments platform and neobank",
    "startup accelerator program",
    "petroleum refinery, founded in 1975",
    "marketplace for buyers and sellers looking for vendors",
    "makes things",
]
TONES = ["professional", "friendly", "casual", "persuasive"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(column: Column, values: list) -> Column:
    """values[column], as a literal array: the index is in range by construction."""
    return F.element_at(F.array(*map(F.lit, values)), (column + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = spread(table(spark, sf_dir, "customer"), "c_custkey"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("company_id"),
        F.col("c_name").alias("name"),
        F.when(key % 10 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example"))).alias("domain"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("industry"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.abs("c_acctbal") / 10).cast("int")).alias("employee_count"),
        (key % 5).alias("search_id"),
        (key % 3).alias("user_id"),
        (45 + key % 50).cast("int").alias("confidence"),
        F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("React"))).when(key % 4 == 2, F.array(F.lit("Python"), F.lit("React"))).otherwise(F.array(F.lit("Stripe"), F.lit("Python"))).alias("technologies"),
        F.when(key % 6 != 0, F.concat(F.col("c_name"), F.lit(" "), _pick(key % len(PHRASES), PHRASES))).alias("description"),
        F.when(key % 10 != 0, F.concat(F.lit("https://www."), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example/about/team"))).alias("website_url"),
        F.when(key % 8 != 0, F.concat(F.lit("https://www.linkedin.com/company/c-"), key)).alias("linkedin_url"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("First"), key % 97, F.lit(" Last"), key % 89)
    title = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in TITLES.items()], F.lit("Team Member"))
    return table(spark, sf_dir, "orders").select(
        key.alias("contact_id"),
        F.col("o_custkey").alias("company_id"),
        name.alias("full_name"),
        title.alias("title"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("first"), key % 97, F.lit(".last"), key % 89, F.lit("@mail"), F.col("o_custkey") % 50, F.lit(".example"))).alias("email"),
        F.when(key % 3 == 1, F.concat(F.lit("https://www.linkedin.com/in/first"), key % 97, F.lit("-last"), key % 89)).alias("linkedin_url"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("enriched_at"),
        F.when(key % 3 != 0, 1.0 + key % 10 + F.when((key % 11 == 0) & (key % 10 < 9), 0.5).otherwise(0.0)).alias("lead_score"),
        _pick(key % 5, ["valid", "invalid", "unknown", "catch_all", None]).alias("email_status"),
        (key % 17 == 0).alias("paused"),
        (key % 13 == 0).alias("discarded"),
        _pick(key % 3, ["email", "linkedin", None]).alias("channel"),
        (key % 100).cast("int").alias("confidence"),
        F.col("o_orderdate").alias("created_at"),
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    sent, replied = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("email_id"),
        F.col("l_orderkey").alias("contact_id"),
        (F.col("l_suppkey") % 40).alias("campaign_id"),
        F.when(sent, "sent").otherwise("draft").alias("status"),
        F.when(replied, "replied").otherwise("none").alias("reply_status"),
        F.when(sent, F.col("l_shipdate")).alias("sent_at"),
        F.when(replied, F.col("l_shipdate") + F.expr("interval 2 days")).alias("replied_at"),
        F.when(F.col("l_linenumber") <= 4, _pick((F.col("l_linenumber") - 1) % 4, TONES)).otherwise("shouting").alias("tone"),
        F.col("l_shipdate").alias("created_at"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("campaign_id"), F.col("s_name").alias("name"), (key % 50).alias("sent_count"), (key % 7).alias("failed_count"), (key * 37 % 1009).alias("created_ord"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("search_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("industry"),
        F.col("p_type").alias("country"),
        F.split("p_name", " ").alias("keywords"),
        _pick(F.col("p_size") % 3, ["draft", "active", "completed"]).alias("status"),
        (key * 17 % 5003).alias("updated_ord"),
        (key * 29 % 7001).alias("created_ord"),
    )


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 3 == 0).select(
        key.alias("follow_up_id"),
        key.alias("contact_id"),
        (key * 10 + 1).alias("source_email_id"),
        _pick(key % 4, ["scheduled", "cancelled", "sent", "skipped"]).alias("status"),
        F.when(key % 4 == 1, F.when(key % 8 == 1, "replied").otherwise("manual")).alias("cancel_reason"),
        F.col("o_orderdate").alias("scheduled_at"),
        (key % 5 == 0).alias("suggested"),
    )


#: The same tables for an engine that has only the driver's views.
VIEWS = {
    "companies": """SELECT c_custkey AS company_id, c_name AS name,
  CASE WHEN c_custkey % 10 <> 0 THEN lower(replace(c_name, '#', '-')) || '.example' END AS domain,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS industry, n_name AS country,
  CASE WHEN c_acctbal >= 0 THEN CAST(floor(abs(c_acctbal) / 10) AS INTEGER) END AS employee_count,
  c_custkey % 5 AS search_id, c_custkey % 3 AS user_id, CAST(45 + c_custkey % 50 AS INTEGER) AS confidence,
  CASE c_custkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['React'] WHEN 2 THEN ['Python', 'React'] ELSE ['Stripe', 'Python'] END AS technologies,
  CASE WHEN c_custkey % 6 <> 0 THEN c_name || ' ' || (@PHRASES@)[CAST(c_custkey % @N@ AS INTEGER) + 1] END AS description,
  CASE WHEN c_custkey % 10 <> 0 THEN 'https://www.' || lower(replace(c_name, '#', '-')) || '.example/about/team' END AS website_url,
  CASE WHEN c_custkey % 8 <> 0 THEN 'https://www.linkedin.com/company/c-' || c_custkey END AS linkedin_url
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "contacts": """SELECT o_orderkey AS contact_id, o_custkey AS company_id, 'First' || (o_orderkey % 97) || ' Last' || (o_orderkey % 89) AS full_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Chief Executive Officer' WHEN '2-HIGH' THEN 'CTO' WHEN '3-MEDIUM' THEN 'VP Engineering' WHEN '4-NOT SPECIFIED' THEN 'Office Manager' WHEN '5-LOW' THEN 'Co-Founder' ELSE 'Team Member' END AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '' ELSE 'first' || (o_orderkey % 97) || '.last' || (o_orderkey % 89) || '@mail' || (o_custkey % 50) || '.example' END AS email,
  CASE WHEN o_orderkey % 3 = 1 THEN 'https://www.linkedin.com/in/first' || (o_orderkey % 97) || '-last' || (o_orderkey % 89) END AS linkedin_url,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS enriched_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN 1.0::DOUBLE + o_orderkey % 10 + CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 10 < 9 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS lead_score,
  CASE o_orderkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'unknown' WHEN 3 THEN 'catch_all' END AS email_status,
  o_orderkey % 17 = 0 AS paused, o_orderkey % 13 = 0 AS discarded, CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'linkedin' END AS channel,
  CAST(o_orderkey % 100 AS INTEGER) AS confidence, o_orderdate AS created_at FROM orders""",
    "emails": """SELECT l_orderkey * 10 + l_linenumber AS email_id, l_orderkey AS contact_id, l_suppkey % 40 AS campaign_id,
  CASE WHEN l_linestatus = 'F' THEN 'sent' ELSE 'draft' END AS status, CASE WHEN l_returnflag = 'R' THEN 'replied' ELSE 'none' END AS reply_status,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sent_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 2 DAY END AS replied_at,
  CASE l_linenumber WHEN 1 THEN 'professional' WHEN 2 THEN 'friendly' WHEN 3 THEN 'casual' WHEN 4 THEN 'persuasive' ELSE 'shouting' END AS tone, l_shipdate AS created_at FROM lineitem""",
    "campaigns": "SELECT s_suppkey AS campaign_id, s_name AS name, s_suppkey % 50 AS sent_count, s_suppkey % 7 AS failed_count, s_suppkey * 37 % 1009 AS created_ord FROM supplier",
    "searches": """SELECT p_partkey AS search_id, p_name AS name, p_brand AS industry, p_type AS country, string_split(p_name, ' ') AS keywords,
  CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' ELSE 'completed' END AS status, p_partkey * 17 % 5003 AS updated_ord, p_partkey * 29 % 7001 AS created_ord FROM part""",
    "follow_ups": """SELECT o_orderkey AS follow_up_id, o_orderkey AS contact_id, o_orderkey * 10 + 1 AS source_email_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'sent' ELSE 'skipped' END AS status,
  CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 8 = 1 THEN 'replied' ELSE 'manual' END END AS cancel_reason, o_orderdate AS scheduled_at, o_orderkey % 5 = 0 AS suggested
  FROM orders WHERE o_orderkey % 3 = 0""",
}

VIEWS["companies"] = VIEWS["companies"].replace("@PHRASES@", "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]").replace("@N@", str(len(PHRASES)))


def with_views(sql: str) -> str:
    """sql with those of VIEWS in front that it names."""
    used = [name for name in VIEWS if name in sql]
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"

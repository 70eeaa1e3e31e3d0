"""CSV in and out: one row a lead, with names of columns as people write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: headers and the fields they stand for
HEADERS = {
    "company": "company", "company_name": "company", "organization": "company",
    "domain": "domain", "website": "domain", "website_url": "domain",
    "industry": "industry", "sector": "industry", "country": "country", "city": "city", "location": "city",
    "contact_name": "contactName", "name": "contactName", "full_name": "contactName", "contact": "contactName",
    "title": "title", "job_title": "title", "role": "title",
    "email": "email", "email_address": "email", "linkedin": "linkedin", "linkedin_url": "linkedin",
}
FIELDS = ["company", "domain", "industry", "country", "city", "contactName", "title", "email", "linkedin"]
# fixed values: columns of the export, in order
EXPORT = ["company", "website", "industry", "country", "city", "employeeSize", "contactName", "title", "email", "emailStatus", "contactType", "linkedin", "leadScore", "overallScore", "qualityCategory", "confidenceScore", "sourceUrl"]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with doubled quotes inside quotes; Spark splits large files between lines."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def leads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): of several headers for one field, the last that is filled counts; a row without a company is an error."""
    named: dict[str, list[str]] = {}
    for column in raw.columns:
        field = HEADERS.get("_".join(column.strip().lower().split()))
        if field:
            named.setdefault(field, []).append(column)
    if "company" not in named:
        raise ValueError('CSV must include a "company" column.')
    value = {}
    for field in FIELDS:
        cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in reversed(named.get(field, []))]
        value[field] = F.coalesce(*cells) if cells else F.lit(None).cast("string")
    host = F.regexp_replace(F.lower(F.regexp_extract(value["domain"], r"^(?:[A-Za-z]+://)?([^/:?#]+)", 1)), r"^www\.", "")
    value |= {"domain": F.nullif(host, F.lit("")), "contactName": F.coalesce(value["contactName"], F.lit("Unknown Contact")), "title": F.coalesce(value["title"], F.lit("Team Member")), "email": F.lower(value["email"])}
    rows = raw.select(*[value[f].alias(f) for f in FIELDS])
    return rows.where("company is not null"), rows.where("company is null").select(F.lit("missing company name").alias("error"))


def entities(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(companies, contacts): the first row of a key makes the company; each row makes a contact with the key."""
    keyed = rows.withColumn("key", F.lower(F.coalesce("domain", "company")))
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("_nth = 1")
    return first.select("key", "company", "domain", "industry", "country", "city"), keyed.select("key", "contactName", "title", "email", "linkedin")


def export(rows: DataFrame, *keys: str) -> DataFrame:
    """The fixed columns as text, blank where a lead has none; keys: columns that go before them as they are."""
    return rows.select(*keys, *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in EXPORT])


def csv_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """line: a row as CSV, quoted only where a cell holds a quote, a comma or a line end; keys go beside it."""
    cell = lambda c: F.when(F.col(c).rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return rows.select(*keys, F.concat_ws(",", *[cell(c) for c in rows.columns if c not in keys]).alias("line"))


def write(rows: DataFrame, path: str) -> None:
    export(rows).write.csv(path, header=True, quote='"', escape='"', emptyValue="")

"""Addresses of a site where people may stand: those that its front page and its sitemap link to, then the usual ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has
from .html_nodes import attribute, nodes

C = F.col
#: Addresses that a sitemap gives, and that a list has beside the usual ones, at most: part of the rule.
DISCOVERED = 22


def site_path(href: Column, host: Column) -> Column:
    """The path of an address on the same host (with or without www.), without query and trailing slash; null for another host, the
    front page, a file, or more than 120 characters.  A path without a slash in front starts at the root."""
    clean = F.trim(href)
    absolute = clean.rlike("(?i)^(https?:)?//")
    other = F.regexp_replace(F.lower(F.regexp_extract(clean, r"(?i)^(?:https?:)?//([^/:?#]+)", 1)), r"^www\.", "")
    rest = F.when(absolute, F.regexp_extract(clean, r"(?i)^(?:https?:)?//[^/?#]+([^?#]*)", 1)).otherwise(F.regexp_extract(clean, r"^([^?#]*)", 1))
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    path = F.regexp_replace(rest, "/$", "")
    there = F.when(absolute, other == F.regexp_replace(F.lower(host), r"^www\.", "")).otherwise(~clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    return F.when(there & (path != "") & (F.length(path) <= 120) & ~path.rlike(r"(?i)\.(pdf|zip|png|jpg|jpeg|gif|svg|css|js)$"), path)


def site_paths(pages: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """pages: page, host, html (front pages); sitemaps: page, xml.  page, place (from 1), url.

    Links that say so by path or text, in order; then up to DISCOVERED of the sitemap; then the usual ones.  Addresses that
    differ in case or a trailing slash only are one, the first; a list ends at DISCOVERED more than there are usual ones.
    """
    hosts = pages.select("page", "host")
    links = nodes(pages.select("page", "html")).where("tag = 'a'").select("page", "node", F.trim(attribute("href")).alias("href"), F.lower(F.trim("text")).alias("text"))
    links = links.where(F.coalesce((C("href") != "") & ~C("href").rlike("^(#|mailto:)"), F.lit(False))).join(hosts, "page").withColumn("path", site_path(C("href"), C("host")))
    home = links.where(C("path").isNotNull() & has(F.concat_ws(" ", "path", "text"), fixed.DIRECTORY_LINK)).select("page", F.lit(1).alias("part"), C("node").alias("nth"), "path")
    listed = sitemaps.where(F.contains("xml", F.lit("<url"))).join(hosts, "page").select("page", "host", F.regexp_extract_all("xml", F.lit("(?i)<loc>([^<]+)</loc>"), F.lit(1)).alias("locs"))
    fits = F.filter(F.transform("locs", lambda x: site_path(x, C("host"))), lambda p: p.isNotNull() & has(p, fixed.DIRECTORY_LINK))
    mapped = listed.select("page", F.posexplode(F.slice(fits, 1, DISCOVERED)).alias("nth", "path")).select("page", F.lit(2).alias("part"), "nth", "path")
    usual = hosts.select("page", F.posexplode(F.array(*map(F.lit, ["", *fixed.LEADERSHIP_PATHS, *fixed.CONTACT_PATHS]))).alias("nth", "path"))
    usual = usual.select("page", F.when(C("path") == "", 0).otherwise(3).alias("part"), "nth", "path")
    once = home.union(mapped).union(usual).groupBy("page", F.lower("path").alias("key")).agg(F.min(F.struct("part", "nth", "path")).alias("first"))
    ordered = once.groupBy("page").agg(F.array_sort(F.collect_list("first")).alias("all"))
    most = F.slice(F.transform("all", lambda x: x["path"]), 1, DISCOVERED + len(fixed.LEADERSHIP_PATHS))
    return ordered.join(hosts, "page").select("page", "host", F.posexplode(most).alias("at", "path")).select("page", (C("at") + 1).alias("place"), F.concat(F.lit("https://"), F.regexp_replace("host", r"^www\.", ""), "path").alias("url"))

"""Recorded replies to well-known addresses of a run's origin: robots, sitemaps, OpenAPI documents, introspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import parsing, urls
from sparkloom.operators import ordered

# Where OpenAPI documents are looked for.
OPENAPI_PATHS = ("/swagger.json", "/openapi.json", "/openapi.yaml", "/openapi.yml", "/v3/api-docs", "/api-docs")


def robots_sitemaps(body: Column) -> Column:
    """The addresses behind ``Sitemap:`` in a robots file."""
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)^sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "(?i)^sitemap:", ""))), lambda x: x != "")


def sitemap_locs(body: Column, origin: Column) -> Column:
    """The ``loc`` texts of a sitemap, by pattern, of the same origin."""
    return F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc>"), 1), lambda u: urls.origin(u) == origin)


def replies(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """wanted (with url) with the body of those that were answered well; others drop out. Either side may be large whatever its estimate, so none is broadcast."""
    ok = responses.where(F.col("status").between(200, 299) & F.col("body").isNotNull() & (F.col("body") != "")).select("url", "body")
    return wanted.join(ok.hint("merge"), "url")


def supplemental_pages(roots: DataFrame, responses: DataFrame) -> DataFrame:
    """roots: run_id, url. Pages of the origin's sitemaps (its own and those robots names): run_id, seq, url; a page keeps the place of its first mention."""
    own = roots.select("run_id", urls.origin(F.col("url")).alias("origin"))
    direct = own.select("run_id", "origin", F.lit(0).alias("k"), F.concat("origin", F.lit("/sitemap.xml")).alias("url"))
    robots = replies(own.withColumn("url", F.concat("origin", F.lit("/robots.txt"))), responses)
    named = robots.select("run_id", "origin", F.posexplode(robots_sitemaps(F.col("body"))).alias("k", "ref"))
    named = named.select("run_id", "origin", (F.col("k") + 1).alias("k"), urls.url_resolve(F.col("ref"), F.concat("origin", F.lit("/"))).alias("url")).where(urls.origin(F.col("url")) == F.col("origin"))
    maps = ordered.first_wins(direct.unionByName(named), ["run_id", "url"], [F.col("k")])
    locs = replies(maps, responses).select("run_id", "k", F.posexplode(sitemap_locs(F.col("body"), F.col("origin"))).alias("j", "loc"), "origin")
    pages = locs.select("run_id", "k", "j", urls.url_resolve(F.col("loc"), F.concat("origin", F.lit("/"))).alias("url")).where("url is not null")
    once = ordered.first_wins(pages, ["run_id", "url"], [F.col("k"), F.col("j")])
    return ordered.cap(once, ["run_id"], [F.col("k"), F.col("j")], 2**31 - 1, "seq").select("run_id", F.col("seq").cast("long").alias("seq"), "url")


def openapi_documents(roots: DataFrame, responses: DataFrame) -> DataFrame:
    """Documents found at the well-known paths: run_id, seq, url, source, title, version, path_summaries, schema_names. Only JSON counts."""
    paths = F.array(*map(F.lit, OPENAPI_PATHS))
    wanted = roots.select("run_id", urls.origin(F.col("url")).alias("origin"), F.posexplode(paths).alias("seq", "path")).select("run_id", "seq", F.concat("origin", "path").alias("url"))
    found = replies(wanted, responses).withColumn("d", parsing.openapi_document(F.col("body"))).where(F.trim("body").startswith("{") & F.col("d").isNotNull() & F.get_json_object("body", "$").isNotNull())
    return found.select("run_id", "seq", "url", F.lit("well-known").alias("source"), "d.*")


def introspected(endpoints: DataFrame, posts: DataFrame) -> DataFrame:
    """GraphQL endpoints with the recorded reply to a schema question: url, introspection_status, operation_types, sample_fields."""
    asked = endpoints.select("url").distinct().join(posts.select("url", "status", "body"), "url", "left")
    return asked.select("url", parsing.introspection(F.col("status"), F.col("body")).alias("i")).select("url", "i.*")

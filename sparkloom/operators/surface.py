"""API surface of artifacts: REST endpoints, GraphQL endpoints and operations, OpenAPI literals.

Artifacts carry run_id (the analysed site), artifact_seq, url and content; all lists and caps are per run, so runs
are spread over the cluster and none needs another's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import WS_CHARS, clip
from sparkloom.functions.urls import absolute_rooted, origin, url_resolve
from sparkloom.operators import ordered
from sparkloom.sources.store import keep

# The patterns of API literals, HTTP methods and caps.
QUOTE = "[\"'`]"
API_PATH = rf"(/(?:api|rest|graphql|v\d+)[^\"'`{WS_CHARS})]+)"
REST_PATTERN = rf"(?i)(?:fetch|axios\.(?:get|post|put|patch|delete)|url\s*:\s*|baseURL\s*:\s*)[^\"'`\n]{{0,80}}{QUOTE}{API_PATH}{QUOTE}"
API_PATTERN = rf"(?i){QUOTE}{API_PATH}{QUOTE}"
#: REST_PATTERN, told at each place by one letter whether any of its words can begin there.
REST_SEARCH = REST_PATTERN.replace("(?i)", "(?i)(?=[faub])", 1)
GRAPHQL_PATTERN = rf"(?i){QUOTE}(https?://[^\"'`{WS_CHARS}]*/graphql[^\"'`{WS_CHARS}]*|/graphql[^\"'`{WS_CHARS}]*){QUOTE}"
OPERATION_PATTERN = r"(query|mutation|subscription)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(([^)]*)\))?\s*\{"
OPENAPI_PATTERN = rf"(?i){QUOTE}(/(?:swagger|openapi|v3/api-docs)[^\"'`]*){QUOTE}"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
PURPOSE_AUTH, PURPOSE_CAPTCHA, PURPOSE_OTHER = "Likely auth/session endpoint", "Likely captcha or risk verification endpoint", "Discovered API endpoint literal"
EXPECT_MUTATION, EXPECT_QUERY = "Mutation response object likely contains status/result payload fields.", "Query response object likely returns typed selection-set fields."
CAPS = {"rest": 80, "openapi": 12, "graphql": 20, "operations": 40}

KEEP = ("run_id", "artifact_seq", "url")


def absolute(reference: Column, base: Column, python: bool) -> Column:
    """Full URL resolution takes Python; rooted references, which are all these patterns find but for http ones, do not."""
    return F.coalesce(url_resolve(reference, base), reference) if python else absolute_rooted(reference, base)


#: Characters before and behind a match's start: where methods, field names and evidence are looked for.
NEAR_METHODS, NEAR_KEYS, NEAR_REST, NEAR_OPERATION, NEAR_OPENAPI = (180, 180), (240, 360), (80, 180), (80, 220), (80, 160)


def _named(up: Column) -> Column:
    return F.concat_ws(",", *(F.when(up.contains(m), m) for m in METHODS))


def method_names(near: Column) -> Column:
    """The methods named nearby, parted by commas."""
    return ordered.bound(F.upper(near), _named)


def method_list(names: Column) -> Column:
    return F.when(names != "", F.split(names, ",")).otherwise(F.array().cast("array<string>"))


def method_hints(near: Column) -> Column:
    return method_list(method_names(near))


def nearby_keys(near: Column) -> Column:
    """Names of up to 41 characters before a colon: a pattern sees only what lies right before each colon."""
    name = lambda x: F.regexp_extract(F.right(F.rtrim(x, F.lit(" \t\n\x0b\f\r")), F.lit(41)), "([A-Za-z_$][A-Za-z0-9_$]{1,40})$", 1)
    names = ordered.bound(F.split(near, ":"), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), name))
    return F.slice(F.filter(names, lambda x: x != ""), 1, 8)


def purpose(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("auth") | low.contains("login"), PURPOSE_AUTH).when(low.contains("captcha"), PURPOSE_CAPTCHA).otherwise(PURPOSE_OTHER)


def api_endpoints(artifacts: DataFrame, python_urls: bool = False, cap: int = CAPS["rest"]) -> DataFrame:
    """run_id, rank, url, methods, source_artifact_url, purpose, request_fields, evidence; unique by url and methods."""
    within = lambda span: ordered.around(F.col("near"), F.least("pos", F.lit(NEAR_KEYS[0])), *span)  # noqa: E731  the widest window holds the others
    found = ordered.matches(artifacts, "content", [REST_SEARCH, API_PATTERN], {"raw": 1}, *KEEP, windows={"near": NEAR_KEYS})
    rows = found.select(
        "run_id", "artifact_seq", "pattern", "match_seq", absolute(F.col("raw"), F.col("url"), python_urls).alias("endpoint"), F.upper(within(NEAR_METHODS)).alias("up"), F.col("url").alias("source_artifact_url"), "near", "pos"
    )
    rows = rows.withColumn("names", _named(F.col("up"))).drop("up")
    order = [F.col("artifact_seq"), F.col("pattern"), F.col("match_seq")]
    once = ordered.first_wins(rows, ["run_id", "endpoint", "names"], order)
    once = once.withColumns({"purpose": purpose(F.col("endpoint")), "request_fields": nearby_keys(F.col("near")), "evidence": clip(within(NEAR_REST))}).drop("near", "pos")
    return ordered.cap(once, ["run_id"], order, cap).select("run_id", "rank", F.col("endpoint").alias("url"), method_list(F.col("names")).alias("methods"), "source_artifact_url", "purpose", "request_fields", "evidence")


def graphql_matches(artifacts: DataFrame, python_urls: bool = False) -> DataFrame:
    rows = ordered.matches(artifacts, "content", GRAPHQL_PATTERN, {"raw": 1}, *KEEP, windows={"evidence_in": NEAR_REST})
    return rows.select(*KEEP, "match_seq", absolute(F.col("raw"), F.col("url"), python_urls).alias("endpoint"), clip(F.col("evidence_in")).alias("evidence"))


def graphql_endpoints(artifacts: DataFrame, python_urls: bool = False, cap: int = CAPS["graphql"]) -> DataFrame:
    order = [F.col("artifact_seq"), F.col("match_seq")]
    once = ordered.first_wins(graphql_matches(artifacts, python_urls), ["run_id", "endpoint"], order)
    return ordered.cap(once, ["run_id"], order, cap).select("run_id", "rank", F.col("endpoint").alias("url"), F.col("url").alias("source_artifact_url"), F.lit("not-attempted").alias("introspection_status"), "evidence")


def with_introspection(endpoints: DataFrame, introspected: DataFrame, targets: DataFrame) -> DataFrame:
    """endpoints with the recorded status, and what else introspected has, of those whose URL starts with the run's page origin; targets: run_id, target_url."""
    own = endpoints.join(targets.select("run_id", origin(F.col("target_url")).alias("page_origin")), "run_id", "left")
    met = own.drop("introspection_status").join(introspected.withColumnRenamed("url", "probed"), F.col("url").startswith(F.col("page_origin")) & (F.col("url") == F.col("probed")), "left")
    return met.withColumn("introspection_status", F.coalesce("introspection_status", F.when(F.col("url").startswith(F.col("page_origin")), "failed"), F.lit("not-attempted"))).drop("probed", "page_origin")


def graphql_operations(artifacts: DataFrame, python_urls: bool = False, cap: int = CAPS["operations"]) -> DataFrame:
    """Operations with the GraphQL endpoint last seen in any artifact up to and with their own, else the page's."""
    ops = ordered.matches(artifacts, "content", OPERATION_PATTERN, {"whole": 0, "kind": 1, "name": 2, "args": 3}, *KEEP, "target_url", windows={"evidence_in": NEAR_OPERATION})
    ops = ops.select(
        *KEEP, F.lit(1).alias("part"), "match_seq", F.lit(None).cast("string").alias("endpoint"), F.col("kind").alias("operation_type"), F.col("name").alias("operation_name"),
        F.regexp_extract_all("args", F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), 1).alias("variables"), clip(F.col("whole")).alias("sample_request"),
        clip(F.col("evidence_in")).alias("evidence"), F.concat(origin(F.col("target_url")), F.lit("/graphql")).alias("fallback"),
    )
    seen = graphql_matches(artifacts, python_urls).select(*KEEP, F.lit(0).alias("part"), "match_seq", "endpoint")
    order = [F.col("artifact_seq"), F.col("part"), F.col("match_seq")]
    both = ordered.running(keep(ops.unionByName(seen, allowMissingColumns=True), "operations"), ["run_id"], F.col("artifact_seq"), order, lasts={"endpoint_url": F.col("endpoint")})
    rows = both.where("part = 1").withColumn("endpoint_url", F.coalesce("endpoint_url", "fallback"))
    response = F.when(F.col("operation_type") == "mutation", EXPECT_MUTATION).otherwise(EXPECT_QUERY)
    once = ordered.first_wins(rows.withColumn("expected_response", response), ["run_id", "endpoint_url", "operation_type", "operation_name", "url"], order)
    return ordered.cap(once, ["run_id"], order, cap).select("run_id", "rank", "endpoint_url", "operation_type", "operation_name", "variables", "sample_request", "expected_response", F.col("url").alias("source_artifact_url"), "evidence")


def openapi_literals(artifacts: DataFrame, fetched: DataFrame | None = None, python_urls: bool = False, cap: int = CAPS["openapi"]) -> DataFrame:
    """OpenAPI documents, unique by URL; literals come before fetched ones (run_id, seq, url and further columns), so they win."""
    rows = ordered.matches(artifacts, "content", OPENAPI_PATTERN, {"raw": 1}, *KEEP, windows={"evidence_in": NEAR_OPENAPI})
    rows = rows.select("run_id", F.lit(0).alias("part"), "artifact_seq", "match_seq", absolute(F.col("raw"), F.col("url"), python_urls).alias("doc_url"), F.lit("artifact-string").alias("source"), clip(F.col("evidence_in")).alias("evidence"))
    if fetched is not None:
        more = fetched.select("run_id", F.lit(1).alias("part"), F.col("seq").cast("long").alias("artifact_seq"), F.lit(0).alias("match_seq"), F.col("url").alias("doc_url"), "source", *(c for c in fetched.columns if c not in ("run_id", "seq", "url", "source")))
        rows = rows.unionByName(more, allowMissingColumns=True)
    order = [F.col("part"), F.col("artifact_seq"), F.col("match_seq")]
    once = ordered.first_wins(rows, ["run_id", "doc_url"], order)
    return ordered.cap(once, ["run_id"], order, cap).drop("part", "artifact_seq", "match_seq").withColumnRenamed("doc_url", "url")

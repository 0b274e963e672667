"""Artifacts, pages and recordings derived from the test tables by one SQL text that Spark and DuckDB both run.

The test tables hold no API calls, forms or GraphQL, so these views make such content by arithmetic on keys. ``orders``
and ``customer`` give one site for each customer, so the views grow with the data and every site is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTIFACTS = """
SELECT o_custkey AS run_id, o_orderkey AS artifact_seq,
  'https://site-' || CAST(o_custkey AS STRING) || '.example.com/auth/login.html' AS target_url,
  CASE o_orderkey % 9 WHEN 0 THEN 'https://cdn.line.example.net' ELSE 'https://site-' || CAST(o_custkey AS STRING) || '.example.com' END || '/assets/'
    || CASE o_orderkey % 6 WHEN 0 THEN 'login' WHEN 1 THEN 'search_result' WHEN 2 THEN 'runtime' WHEN 3 THEN 'vendor' WHEN 4 THEN 'Checkout' ELSE 'profile-worker' END
    || '-' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 7 WHEN 0 THEN '.wasm' WHEN 1 THEN '.map' ELSE '.js' END AS url,
  CASE o_orderkey % 7 WHEN 0 THEN 'wasm' WHEN 1 THEN 'source-map' WHEN 2 THEN 'worker' WHEN 3 THEN 'service-worker' ELSE 'script' END AS type,
  CASE o_orderkey % 4 WHEN 0 THEN 'html:script' WHEN 1 THEN 'html:inline-script' WHEN 2 THEN 'html:iframe' ELSE 'html:form' END AS discovered_from,
  o_orderkey * 37 % 700000 AS size_bytes,
  'import { a } from "./chunk-' || CAST(o_orderkey % 10 AS STRING) || '.js"; '
    || CASE o_orderkey % 4 WHEN 0 THEN 'fetch("/api/v1/auth/login-' || CAST(o_orderkey % 13 AS STRING) || '", { method: "POST", body: { user: u, token: t } }); '
       WHEN 1 THEN 'axios.get("/rest/items/' || CAST(o_orderkey % 11 AS STRING) || '");   const o = { url: "/v2/search?q=' || CAST(o_orderkey % 3 AS STRING) || '" }; '
       WHEN 2 THEN 'new Worker("/workers/w' || CAST(o_orderkey % 5 AS STRING) || '.js"); navigator.serviceWorker.register("/sw.js"); '
       ELSE 'const base = "/api/telemetry/collect"; ' END
    || CASE o_orderkey % 5 WHEN 0 THEN 'const q = "/graphql"; query Viewer' || CAST(o_orderkey % 4 AS STRING) || '($id: ID!, $n: Int) { viewer { id } } '
       WHEN 1 THEN 'mutation Save' || CAST(o_orderkey % 3 AS STRING) || '($input: In) { save { ok } } '
       WHEN 2 THEN 'const docs = "/openapi/v' || CAST(o_orderkey % 2 AS STRING) || '.json"; ' ELSE '' END
    || CASE o_orderkey % 6 WHEN 0 THEN 'navigator.userAgent + screen.width; canvas.toDataURL(); '
       WHEN 1 THEN 'crypto.subtle.digest("SHA-256", payload); btoa(token); '
       WHEN 2 THEN 'throw new Error("invalid captcha response"); grecaptcha; turnstile.render(); '
       WHEN 3 THEN 'localStorage.setItem("session", Authorization); document.cookie; show("token expired"); ' ELSE '' END
    || '//# sourceMappingURL=app-' || CAST(o_orderkey AS STRING) || '.map' AS content
FROM orders
"""

#: A page with a form for each customer; the arrays are what a snapshot of it holds.
SNAPSHOTS = """
SELECT c_custkey AS run_id, CAST(0 AS INT) AS page_seq, 'https://site-' || CAST(c_custkey AS STRING) || '.example.com/auth/login.html' AS url,
  CASE c_custkey % 3 WHEN 0 THEN 'Sign in' WHEN 1 THEN 'Login to shop' ELSE 'Welcome' END AS title,
  CASE c_custkey % 4 WHEN 0 THEN 'Reset password' WHEN 1 THEN 'Captcha check' ELSE 'Offers' END AS heading,
  CASE c_custkey % 2 WHEN 0 THEN 'password' ELSE 'text' END AS input_type,
  'https://site-' || CAST(c_custkey AS STRING) || '.example.com/session' AS action,
  CASE c_custkey % 2 WHEN 0 THEN 'Log in' ELSE 'Go' END AS button
FROM customer
"""

#: Requests of a traced session for each event.
REQUESTS = """
SELECT user_id AS run_id, event_id AS seq, 'https://app.example.com/' || CASE event_type WHEN 'signup' THEN 'api/signup' WHEN 'error' THEN 'challenge/verify' WHEN 'click' THEN 'collect' WHEN 'view' THEN 'page' ELSE 'device/profile' END
    || '/' || CAST(event_id % 17 AS STRING) AS url,
  CASE event_id % 5 WHEN 0 THEN 'token=' || CAST(event_id AS STRING) ELSE NULL END AS request_body_snippet,
  CASE event_id % 6 WHEN 0 THEN 'Turnstile widget ready' WHEN 1 THEN 'using AES and crypto.subtle.encrypt' WHEN 2 THEN 'plain message' ELSE '' END AS console_text,
  CASE event_id % 2 WHEN 0 THEN 'warning' ELSE 'log' END AS console_type,
  CASE event_id % 11 WHEN 0 THEN 'Error: hcaptcha failed' WHEN 1 THEN 'TypeError: RSA is not defined' ELSE NULL END AS page_error,
  CASE event_id % 2 WHEN 0 THEN 'fetch' ELSE 'document' END AS resource_type
FROM events
"""

#: What the page of a traced session held at the end: names are lists in one text, parted by bars.
SESSIONS = """
SELECT user_id AS run_id, CASE user_id % 3 WHEN 0 THEN '<p>geetest PBKDF2</p>' WHEN 1 THEN '<p>plain</p>' ELSE NULL END AS page_text,
  CASE user_id % 4 WHEN 0 THEN 'grecaptcha|app|deviceInfo' WHEN 1 THEN 'arkoseEnforcement|cryptoHMAC' ELSE 'app' END AS global_names,
  CASE user_id % 2 WHEN 0 THEN 'sid|theme' ELSE 'sid' END AS cookie_names, 'k' || CAST(user_id % 5 AS STRING) AS local_storage_keys
FROM (SELECT DISTINCT user_id FROM events) u
"""

#: Site graphs: a site for sixty customers, so sites grow with the data; each page links to two others by arithmetic.
SITE_LINKS = """
SELECT CAST(FLOOR(c_custkey / 60) AS BIGINT) AS run_id, c_custkey % 60 AS page, (c_custkey % 60 * 2 + k) % 60 AS target FROM customer, (SELECT 1 AS k UNION ALL SELECT 2 AS k) y
"""

VIEWS = {"artifacts": ARTIFACTS, "snapshots": SNAPSHOTS, "requests": REQUESTS, "sessions": SESSIONS, "site_links": SITE_LINKS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By what the rows of a table are dealt out.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt out by its key. A file of keys is a few row groups, so a few tasks, while what is made of each row is much."""
    rows = read(spark, sf_dir, name)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, KEYS[name]) if name in KEYS else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    tables = [t for t in ("orders", "customer", "events", "nation") if f"FROM {t}" in sql or f", {t} " in sql]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f", {t} ", f", {{{t}}} ")
    return spark.sql(sql, **{t: spread(spark, sf_dir, t) for t in tables})

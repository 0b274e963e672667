"""Registered queries of probes, filters, agents, catalogs and renderings, on recordings that both engines make by arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import parsing, text, urls
from sparkloom.operators import candidates, dom, flows, planner, probes, surface
from sparkloom.plans import agents, analysis, run
from sparkloom.plans.queries import _ENDS, _GQL_ENDS, joined, query
from sparkloom.sources.store import keep
from sparkloom.sources.synthetic import spread, view


def rows_of(spark, sf_dir, sql: str, table: str):
    """A SQL text over one test table, which DuckDB runs too."""
    escaped = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(escaped.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spread(spark, sf_dir, table)})


_EXT = "CASE p_partkey % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG?v=1' WHEN 2 THEN '.js' WHEN 3 THEN '.woff2#x' WHEN 4 THEN '.pdf' WHEN 5 THEN '/' WHEN 6 THEN '.html' ELSE '.pngx' END"
_KIND = "CASE p_partkey % 6 WHEN 0 THEN ' IMAGE/png' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'Font/woff' WHEN 4 THEN 'application/json' ELSE 'video/mp4' END"
_PARTS = f"SELECT p_partkey, 'https://h.example.com/a' || CAST(p_partkey AS STRING) || {_EXT} AS url, {_KIND} AS content_type FROM part"


@query(f"""SELECT p_partkey, regexp_matches(url, '(?i)\\.({urls.ASSET_ENDINGS})($|[?#])') AS asset, regexp_matches(lower(trim(content_type)), '{urls.IGNORED_CONTENT}') AS ignored FROM ({_PARTS}) p""")
def asset_filters(spark, sf_dir):
    return rows_of(spark, sf_dir, _PARTS, "part").select("p_partkey", urls.is_asset(F.col("url")).alias("asset"), urls.is_ignored_content(F.col("content_type")).alias("ignored"))


_CAND = """SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'site' ELSE 'page' END AS scope, CASE c_custkey % 3 WHEN 0 THEN 'https://s.example.com/shop/cart/index.html' ELSE 'https://s.example.com/login.html' END AS root,
  'https://s.example.com' || CASE c_custkey % 7 WHEN 0 THEN '/login.html' WHEN 1 THEN '/Login/help' WHEN 2 THEN '/shop/cart/2' WHEN 3 THEN '/signup' WHEN 4 THEN '/about' WHEN 5 THEN '/login.html/x' ELSE '/shop/other' END AS url,
  CASE c_custkey % 5 WHEN 0 THEN 'script' ELSE 'html' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'html:iframe' WHEN 1 THEN 'html:form' ELSE 'html:a' END AS discovered_from FROM customer"""


@query(f"""SELECT id, CASE WHEN scope = 'site' OR type <> 'html' OR discovered_from = 'html:iframe' THEN true WHEN discovered_from = 'html:form' THEN regexp_matches(p, '{urls.AUTH_LIKE}') WHEN p = e THEN true
  WHEN root LIKE '%/shop/%' THEN starts_with(p, '/shop/cart/') WHEN starts_with(p, '/login') THEN true ELSE starts_with(p, e || '/') END AS follow
FROM (SELECT *, lower(regexp_extract(url, '^https://[^/]*(.*)$', 1)) AS p, lower(regexp_extract(root, '^https://[^/]*(.*)$', 1)) AS e FROM ({_CAND}) c) x""")
def nested_candidates(spark, sf_dir):
    df = rows_of(spark, sf_dir, _CAND, "customer")
    return df.select("id", candidates.nested_filter(df, F.col("root"), F.col("scope")).alias("follow"))


_PAGE = """SELECT c_custkey AS id, 'https://s' || CAST(c_custkey AS STRING) || '.example.com/a/b.html' AS url, '<html><head><title> T ' || CAST(c_custkey AS STRING) || '</title><meta name="Description" content=" about  it "></head><body data-user-id="1"><h2>two</h2><h1> one &amp; ' || CAST(c_custkey % 9 AS STRING)
  || '</h1><form action="/go/' || CAST(c_custkey AS STRING) || '" method="' || CASE c_custkey % 2 WHEN 0 THEN 'post' ELSE '' END || '" data-k="x"><input name="user" type="email"><input name="pw" type="password"><select name="lang"></select><textarea name="note">x</textarea><button>Log <b>in</b></button><input type="submit" value="Go"></form>'
  || CASE c_custkey % 3 WHEN 0 THEN '<form><input type="tel"></form>' ELSE '' END || '<button value="v">no</button><button aria-label="close"></button><iframe src="f' || CAST(c_custkey AS STRING) || '"></iframe><a href="/x">link</a><a href="/y" aria-label="icon"></a><a>none</a><a href=" ">blank</a></body></html>' AS html FROM customer"""


@query("""SELECT c_custkey AS id, 'T ' || c_custkey AS title, 'about it' AS description, 'one & ' || c_custkey % 9 || '|two' AS headings, 'https://s' || c_custkey || '.example.com/go/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '|https://s' || c_custkey || '.example.com/a/b.html' ELSE '' END AS actions,
  CASE c_custkey % 2 WHEN 0 THEN 'POST' ELSE 'GET' END || CASE WHEN c_custkey % 3 = 0 THEN '|GET' ELSE '' END AS methods, 'user|pw|note|lang' AS input_names, 'email|password|submit' || CASE WHEN c_custkey % 3 = 0 THEN '|tel' ELSE '' END AS input_types, 'Log in|Go' AS submit_labels,
  'Log in|v|close|Go' AS buttons, 'link|icon' AS links, 'https://s' || c_custkey || '.example.com/a/f' || c_custkey AS iframes, 'user-id|k' AS data_keys FROM customer""")
def form_snapshots(spark, sf_dir):
    s = rows_of(spark, sf_dir, _PAGE, "customer").select("id", dom.dom_snapshot("html", "url").alias("s"))
    of = lambda f: F.flatten(F.transform("s.forms", lambda x: x[f]))
    each = lambda f: F.transform("s.forms", lambda x: x[f])
    out = s.select(
        "id", "s.title", "s.description", "s.headings", each("action").alias("actions"), each("method").alias("methods"), of("input_names").alias("input_names"), of("input_types").alias("input_types"), of("submit_labels").alias("submit_labels"),
        "s.buttons", "s.links", "s.iframes", F.col("s.data_attribute_keys").alias("data_keys"),
    )
    return joined(out, *out.columns[3:])


# --- probes

_ORIGIN = "'https://s' || CAST(c_custkey AS STRING) || '.example.com'"
_ROOTS = f"SELECT c_custkey AS run_id, {_ORIGIN} || '/' AS url FROM customer"
_WELL_KNOWN = f"""SELECT {_ORIGIN} || path AS url, CASE WHEN c_custkey % 5 = k THEN 404 ELSE 200 END AS status, CASE k WHEN 0 THEN 'User-agent: *' || chr(10) || 'Sitemap: /more.xml' || chr(10) || 'sitemap: https://else.example.com/x.xml'
    WHEN 1 THEN '<urlset><loc>' || {_ORIGIN} || '/p/1</loc><loc>https://else.example.com/p</loc></urlset>' WHEN 2 THEN '<loc> ' || {_ORIGIN} || '/p/2 </loc><loc>' || {_ORIGIN} || '/p/1</loc>'
    WHEN 3 THEN CASE c_custkey % 3 WHEN 0 THEN 'openapi: 3' ELSE '{{"openapi":"3.1","info":{{"title":"S' || CAST(c_custkey AS STRING) || '"}},"paths":{{"/x":{{"get":{{"summary":"List"}}}}}},"components":{{"schemas":{{"A":{{}}}}}}}}' END ELSE '{{"swagger":"2.0","paths":{{}}}}' END AS body
  FROM customer, (SELECT 0 AS k, '/robots.txt' AS path UNION ALL SELECT 1, '/sitemap.xml' UNION ALL SELECT 2, '/more.xml' UNION ALL SELECT 3, '/openapi.json' UNION ALL SELECT 4, '/swagger.json') w"""


def _recorded(spark, sf_dir):
    return rows_of(spark, sf_dir, _ROOTS, "customer"), rows_of(spark, sf_dir, _WELL_KNOWN, "customer")


@query(f"""WITH ok AS (SELECT c_custkey AS run_id, c_custkey % 5 <> 0 AS robots, c_custkey % 5 <> 1 AS main, c_custkey % 5 <> 2 AS more, {_ORIGIN} AS o FROM customer),
  found AS (SELECT run_id, 0 AS k, o || '/p/1' AS url FROM ok WHERE main UNION ALL SELECT run_id, 1, o || '/p/2' FROM ok WHERE robots AND more UNION ALL SELECT run_id, 2, o || '/p/1' FROM ok WHERE robots AND more AND NOT main)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY k) AS seq, url FROM found""")
def supplemental_pages(spark, sf_dir):
    return probes.supplemental_pages(*_recorded(spark, sf_dir))


@query(f"""SELECT c_custkey AS run_id, {_ORIGIN} || '/swagger.json' AS url, NULL AS title, '2.0' AS version, '' AS path_summaries, '' AS schema_names FROM customer WHERE c_custkey % 5 <> 4
UNION ALL SELECT c_custkey, {_ORIGIN} || '/openapi.json', 'S' || c_custkey, '3.1', 'GET /x - List', 'A' FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey % 3 <> 0""")
def openapi_probes(spark, sf_dir):
    return joined(probes.openapi_documents(*_recorded(spark, sf_dir)).select("run_id", "url", "title", "version", "path_summaries", "schema_names"), "path_summaries", "schema_names")


@query(f"""SELECT run_id, url, body FROM (SELECT c_custkey AS run_id, {_ORIGIN} || '/robots.txt' AS u FROM customer) r JOIN ({_WELL_KNOWN}) w ON r.u = w.url WHERE status BETWEEN 200 AND 299""")
def optional_texts(spark, sf_dir):
    roots, responses = _recorded(spark, sf_dir)
    return probes.replies(roots.select("run_id", F.concat(urls.origin(F.col("url")), F.lit("/robots.txt")).alias("url")), responses)


_POSTS = """SELECT 'https://site-' || CAST(c_custkey AS STRING) || '.example.com/graphql' AS url, CASE c_custkey % 4 WHEN 0 THEN 403 ELSE 200 END AS status, CASE c_custkey % 4 WHEN 1 THEN 'no json' ELSE '{"data":{"__schema":{"queryType":{"name":"Q"},"types":[{"kind":"OBJECT","name":"A"}]}}}' END AS body FROM customer WHERE c_custkey % 3 <> 2"""


@query(f"""WITH$, {_GQL_ENDS}, posts AS ({_POSTS}), e AS (SELECT gq_ends.*, 'https://site-' || run_id || '.example.com' AS page_origin FROM gq_ends)
SELECT run_id, rank, e.url, CASE WHEN NOT starts_with(e.url, page_origin) THEN 'not-attempted' WHEN status IS NULL THEN 'failed' WHEN status = 403 THEN 'blocked' WHEN body = 'no json' THEN 'failed' ELSE 'supported' END AS introspection_status,
  CASE WHEN starts_with(e.url, page_origin) AND status = 200 AND body <> 'no json' THEN 'OBJECT:A' ELSE '' END AS sample_fields FROM e LEFT JOIN posts ON e.url = posts.url""")
def graphql_introspected(spark, sf_dir):
    a = view(spark, sf_dir, "artifacts")
    ends, posts = surface.graphql_endpoints(a), rows_of(spark, sf_dir, _POSTS, "customer")
    out = surface.with_introspection(ends, probes.introspected(ends, posts), a.select("run_id", "target_url").distinct())
    return out.select("run_id", F.col("rank").cast("long").alias("rank"), "url", "introspection_status", F.coalesce(F.array_join("sample_fields", "|"), F.lit("")).alias("sample_fields"))


_REPLY = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'application/JSON' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' ELSE '' END AS content_type, CASE WHEN event_id % 3 = 0 THEN event_id * 100 END AS length, repeat('ab  c ', CAST(event_id % 90 AS INT)) AS body FROM events"


@query(f"""SELECT event_id, CASE WHEN regexp_matches(content_type, '(?i)(json|text)') AND coalesce(length, 0) <= 32000 THEN CASE WHEN len(s) > 300 THEN substring(s, 1, 300) || '…' ELSE s END END AS snippet
FROM (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM ({_REPLY.replace('AS INT', 'AS BIGINT')}) r) x""")
def response_snippets(spark, sf_dir):
    return rows_of(spark, sf_dir, _REPLY, "events").select("event_id", run.response_snippet(F.col("content_type"), F.col("length"), F.col("body")).alias("snippet"))


# --- agents

_CHUNKS = """SELECT c_custkey AS run_id, CAST(1 AS BIGINT) AS artifact_seq, CAST(k AS INT) AS chunk_index, 'code ' || CAST(c_custkey AS STRING) || '.' || CAST(k AS STRING) AS chunk, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority
FROM customer, (SELECT 0 AS k UNION ALL SELECT 1) v"""
_REPLIES = """SELECT c_custkey AS run_id, CAST(1 AS BIGINT) AS artifact_seq, CAST(k AS INT) AS chunk_index, agent, CAST(n AS INT) AS attempt, CASE WHEN (c_custkey + k + n) % 3 = 0 THEN 'broken {' WHEN agent = 'scout' THEN '```json' || chr(10) || '{"role":"scout","summary":"seen ' || CAST(c_custkey AS STRING) || '"}' || chr(10) || '```'
    ELSE 'Here: {"summary":"does ' || CAST(n AS STRING) || '","entryPoints":[{"symbol":"s' || CAST(c_custkey % 7 AS STRING) || '","description":"d","evidence":"e"}],"callGraph":[{"caller":"s","callee":"t","rationale":"r"}],"risks":["r' || CAST(k AS STRING) || '","r"]}' END AS raw_text
FROM customer, (SELECT 0 AS k UNION ALL SELECT 1) v, (SELECT 'scout' AS agent UNION ALL SELECT 'synthesizer') a, (SELECT 1 AS n UNION ALL SELECT 2) t WHERE n = 1 OR c_custkey % 2 = 0"""
#: Of a task the attempt that counts, as the arithmetic has it: the first that is not broken, else the last.
_BEST = """best AS (SELECT c_custkey AS run_id, k AS chunk_index, CASE WHEN (c_custkey + k + 1) % 3 <> 0 THEN 1 WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS n FROM customer, (VALUES (0), (1)) v(k))"""


def _tasks(spark, sf_dir):
    chunks = rows_of(spark, sf_dir, _CHUNKS, "customer").withColumn("agents", planner.agent_plan(F.col("priority"), F.col("chunk_index")))
    return agents.tasks(chunks), rows_of(spark, sf_dir, _REPLIES, "customer")


@query(f"WITH {_BEST} SELECT run_id, chunk_index, agent, CASE WHEN n = 0 THEN 1 ELSE n END AS tries FROM best, (VALUES ('scout'), ('synthesizer')) a(agent)")
def best_replies(spark, sf_dir):
    return agents.best_replies(_tasks(spark, sf_dir)[1]).select("run_id", "chunk_index", "agent", "tries")


@query(f"""WITH {_BEST} SELECT run_id, chunk_index, n = 0 AS fell_back, CASE WHEN n > 0 THEN 'does ' || n ELSE '{agents.NO_REPLY}' END AS summary, CASE WHEN n > 0 THEN 's' || run_id % 7 ELSE '' END AS entries, CASE WHEN n > 0 THEN 'r' || chunk_index || '|r' ELSE '' END AS risks FROM best""")
def chunk_analyses(spark, sf_dir):
    rows, replies = _tasks(spark, sf_dir)
    out = agents.chunk_analyses(rows, agents.memos(rows, replies), replies)
    return joined(out.select("run_id", "chunk_index", "fell_back", "summary", F.transform("entryPoints", lambda x: x["symbol"]).alias("entries"), "risks"), "entries", "risks")


@query(f"""WITH {_BEST}, plan AS (SELECT run_id, chunk_index, n, run_id % 3 AS p FROM best) SELECT run_id, chunk_index, agent, CASE WHEN agent = 'scout' AND n > 0 THEN 'seen ' || run_id ELSE agent || ' agent failed after retries: no valid reply' END AS summary, NOT (agent = 'scout' AND n > 0) AS failed
FROM plan, (VALUES ('scout'), ('runtime'), ('naming'), ('security')) a(agent) WHERE CASE p WHEN 0 THEN chunk_index = 0 OR agent IN ('runtime', 'security') WHEN 1 THEN CASE WHEN chunk_index = 0 THEN agent <> 'naming' ELSE agent = 'scout' END ELSE chunk_index = 0 AND agent = 'scout' END""")
def agent_memos(spark, sf_dir):
    rows, replies = _tasks(spark, sf_dir)
    return agents.memos(rows, replies).select("run_id", "chunk_index", "agent", F.col("memo.summary").alias("summary"), "failed")


@query(f"""WITH {_BEST}, e AS (SELECT run_id, chunk_index AS c FROM best WHERE n > 0), first AS (SELECT run_id, min(c) AS c FROM e GROUP BY run_id)
SELECT run_id, 'entryPoints' AS kind, 1::BIGINT AS rank, 's' || run_id % 7 || ':d' AS key FROM first UNION ALL SELECT run_id, 'callGraph', 1, 's->t' FROM first
UNION ALL SELECT run_id, 'risks', row_number() OVER (PARTITION BY run_id ORDER BY c, j), key FROM (SELECT e.run_id, e.c, 1 AS j, 'r' || e.c AS key FROM e UNION ALL SELECT run_id, c, 2, 'r' FROM first) r""")
def merged_findings(spark, sf_dir):
    rows, replies = _tasks(spark, sf_dir)
    merged = run.merged_analysis(agents.keyed(agents.chunk_analyses(rows, agents.memos(rows, replies), replies)))
    return merged.select("run_id", "kind", F.col("rank").cast("long").alias("rank"), "key")


@query(f"""SELECT run_id, chunk_index, 'Target page: https://t' || run_id || chr(10) || chr(10) || 'Artifact URL: https://a' || run_id || chr(10) || chr(10) || 'Artifact type: script' || chr(10) || chr(10) || 'Discovered from: html:script' || chr(10) || chr(10) || 'Chunk ' || (chunk_index + 1) || ' of 2' || chr(10) || chr(10) || 'Formatting note: '
  || CASE WHEN run_id % 2 = 0 THEN 'raw' ELSE 'none' END || chr(10) || chr(10) || CASE WHEN chunk_index > 0 THEN 'Artifact primer from earlier chunk(s):' || chr(10) || 'p' || run_id ELSE 'Artifact primer from earlier chunk(s): none' END || chr(10) || chr(10) || 'Swarm memory:' || chr(10) || '{{}}' || chr(10) || chr(10)
  || CASE WHEN run_id % 2 = 0 THEN 'Local RAG evidence:' || chr(10) || 'Segment 1:' || chr(10) || 'x' || chr(10) || chr(10) || 'Segment 2:' || chr(10) || 'y' ELSE 'Local RAG evidence: none' END || chr(10) || chr(10) || 'Artifact content:' || chr(10) || chr(10) || '```text' || chr(10) || chr(10) || chunk || chr(10) || chr(10) || '```' AS prompt
FROM ({_CHUNKS}) c WHERE chunk_index = 0 OR priority <> 'low'""".replace("WHERE chunk_index = 0 OR priority <> 'low'", ""))
def prompt_envelopes(spark, sf_dir):
    rows, _ = _tasks(spark, sf_dir)
    rows = rows.where("agent = 'synthesizer'")
    run_id = F.col("run_id").cast("string")
    own = rows.select("run_id", "artifact_seq").distinct()
    artifacts = own.select("run_id", "artifact_seq", F.concat(F.lit("https://a"), run_id).alias("url"), F.lit("script").alias("type"), F.lit("html:script").alias("discovered_from"), F.when(F.col("run_id") % 2 == 0, "raw").alias("formatting_note"), F.concat(F.lit("https://t"), run_id).alias("target_url"))
    primers = own.select("run_id", "artifact_seq", F.concat(F.lit("p"), run_id).alias("primer"))
    retrieved = rows.where("run_id % 2 = 0").select("run_id", "artifact_seq", "chunk_index", "agent", F.array(F.lit("x"), F.lit("y")).alias("segments"))
    return agents.prompts(rows, artifacts, None, primers, retrieved).select("run_id", "chunk_index", "prompt")


@query(f"""SELECT run_id, chunk_index, substring('{agents.KEYWORDS['synthesizer']} ' || chunk || ' ', 1, 6000) AS query, chunk AS exclude FROM ({_CHUNKS}) c""")
def retrieval_queries(spark, sf_dir):
    rows, _ = _tasks(spark, sf_dir)
    return agents.retrieval_queries(rows.where("agent = 'synthesizer'")).select("run_id", "chunk_index", "query", "exclude")


# --- catalogs, graphs, renderings

_CATALOG = """SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN '[' WHEN 1 THEN '{"data":[' WHEN 2 THEN '{"models":[' WHEN 3 THEN '{"items":[' ELSE 'x[' END || '{"id":" m' || CAST(s_suppkey AS STRING) || ' ","display_name":"","label":"L","context_window":"128k"},{"slug":"s","name":"N"},{"label":"no id"},"text",{"id":"m' || CAST(s_suppkey AS STRING) || '","max_tokens":4096}' || CASE s_suppkey % 5 WHEN 0 THEN ']' ELSE ']}' END AS payload FROM supplier"""


@query("""SELECT s_suppkey AS id, e.model, e.label, e.context FROM supplier, LATERAL (SELECT 'm' || s_suppkey AS model, NULL AS label, 4096::BIGINT AS context UNION ALL SELECT 'N', 'N', NULL) e WHERE s_suppkey % 5 <> 4""")
def catalog_entries(spark, sf_dir):
    rows = rows_of(spark, sf_dir, _CATALOG, "supplier").select("id", F.explode(parsing.catalog_entries("payload")).alias("e"))
    return rows.select("id", F.col("e.id").alias("model"), F.col("e.label").alias("label"), F.col("e.context").alias("context"))


_RELATED = """SELECT o_custkey AS run_id, o_orderkey AS artifact_seq, 'https://h.example.com/' || CAST(o_orderkey AS STRING) AS url, 'n' || CAST(o_orderkey % 4 AS STRING) AS name FROM orders"""


@query(f"""SELECT run_id, 'n' || k AS id, coalesce(array_to_string(list(url ORDER BY artifact_seq)[1:8], '|'), '') AS artifact_urls FROM (SELECT DISTINCT o_custkey AS run_id, k FROM orders, (VALUES (0), (1), (2), (3), (4)) v(k)) n LEFT JOIN ({_RELATED}) r USING (run_id) WHERE name = 'n' || k GROUP BY run_id, k
UNION ALL SELECT run_id, 'n' || k, '' FROM (SELECT DISTINCT o_custkey AS run_id, k FROM orders, (VALUES (0), (1), (2), (3), (4)) v(k)) n WHERE (run_id, k) NOT IN (SELECT o_custkey, o_orderkey % 4 FROM orders)""")
def node_artifacts(spark, sf_dir):
    rows = rows_of(spark, sf_dir, _RELATED, "orders")
    nodes = rows.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(f"n{k}") for k in range(5)))).alias("id"))
    out = analysis.node_artifacts(nodes, rows, rows.select("run_id", "artifact_seq", F.array("name").alias("names")))
    return joined(out, "artifact_urls")


_LINE = """SELECT event_id, event_id % 9 AS done, CAST(8 AS BIGINT) AS total, event_id * 977 % 9000000 AS elapsed, CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'streaming' ELSE 'completed' END AS state, 'https://cdn.example.com/' || repeat('x', CAST(event_id % 70 AS INT)) || '/app.js' AS url,
  CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS lane, CASE WHEN event_id % 5 <> 0 THEN event_id % 6 END AS chunk, CASE WHEN event_id % 7 = 0 THEN event_id % 900 END AS tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 700 END AS estimated, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS DOUBLE) / 2 END AS tps, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 95 WHEN 2 THEN 115 ELSE 150 END AS terminal FROM events"""
_DURATION = "CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END"
_SHORT = lambda n: f"CASE WHEN len(url) <= {n} THEN url WHEN {n} <= 3 THEN substring(url, 1, ({n})::INT) ELSE substring(url, 1, greatest(1, ceil(({n} - 3) * 0.7))::INT) || '...' || right(url, greatest(1, {n} - 3 - greatest(1, ceil(({n} - 3) * 0.7)))::INT) END"
_LINE_SQL = f"""l AS (SELECT *, greatest(80, terminal) AS wide, CASE WHEN greatest(80, terminal) >= 140 THEN 24 WHEN greatest(80, terminal) >= 110 THEN 20 WHEN greatest(80, terminal) >= 90 THEN 16 ELSE 12 END AS w, least(1.0, greatest(0.0, done::DOUBLE / greatest(1, total))) AS share,
    coalesce('lane ' || lane || ' ', '') AS lane_label, CASE WHEN state IN ('streaming', 'completed') THEN state ELSE 'running' END AS state_label, coalesce(' chunk ' || chunk || '/6', '') AS chunk_label,
    coalesce(' [' || coalesce(tokens || ' tok', '~' || estimated || ' tok') || coalesce(' ' || regexp_replace(tps::VARCHAR, '\\.0$', '') || ' tps', '') || ']', '') AS told, CASE WHEN done > 0 AND done < total AND elapsed > 0 THEN round(round(elapsed / done::DOUBLE * (total - done)) / 1000.0)::BIGINT END AS s FROM ({_LINE.replace('AS INT', 'AS BIGINT')}) r),
  m AS (SELECT *, '[' || repeat('=', round(share * w)::INT) || repeat('-', w - round(share * w)::INT) || '] ' || round(share * 100)::INT || '% ' || lane_label || 'scout agent ' || state_label || ' ' AS prefix, coalesce({_DURATION}, '') AS eta FROM l),
  f AS (SELECT *, CASE WHEN eta <> '' THEN ' [eta ' || eta || ']' ELSE '' END AS eta1, CASE WHEN eta <> '' THEN ' eta ' || eta ELSE '' END AS eta2 FROM m)"""


def _fits(suffix: str) -> str:
    room = f"greatest(1, wide - len(prefix) - len({suffix}))"
    line = f"prefix || {_SHORT(room)} || {suffix}"
    return f"WHEN (wide - len(prefix) - len({suffix}) >= 4 OR len({suffix}) = 0) AND len({line}) <= wide THEN {line}"


@query(f"""WITH {_LINE_SQL} SELECT event_id, CASE {_fits('(chunk_label || told || eta1)')} {_fits('(chunk_label || told)')} {_fits('chunk_label')} {_fits("''")} ELSE prefix || {_SHORT('8')} END AS line,
  lane_label || 'scout ' || state_label || ' ' || {_SHORT("greatest(18, wide - len(lane_label || 'scout ' || state_label) - len(chunk_label) - len(told) - len(eta2) - 4)")} || chunk_label || told || eta2 AS log FROM f""")
def progress_lines(spark, sf_dir):
    rows = rows_of(spark, sf_dir, _LINE, "events")
    c = {n: F.col(n) for n in ("done", "total", "elapsed", "state", "url", "lane", "chunk", "tokens", "estimated", "tps", "terminal")} | {"agent": F.lit("scout"), "chunks": F.lit(6)}
    return rows.select("event_id", text.progress_line(**c).alias("line"), text.log_line(**c).alias("log"))


_SAID = r"""SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '<b class=''x''>&"' WHEN 1 THEN '  ' WHEN 2 THEN 'Rate Limit reached' WHEN 3 THEN 'bad API key' ELSE '' END || CASE WHEN (conv_id + turn) % 5 = 1 THEN '' ELSE text END AS said FROM conversations"""


@query(f"""SELECT conv_id, turn, nullif(trim(regexp_replace(said, '\\s+', ' ', 'g')), '') AS normal, replace(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  CASE WHEN len(p) > 1400 THEN substring(p, 1, 1400) || chr(10) || '…' ELSE p END AS preview, CASE WHEN contains(lower(said), 'rate limit') THEN 'The provider''s rate limit was reached; wait and run again.' WHEN contains(lower(said), 'api key') THEN 'The provider refused the API key.' ELSE said END AS error,
  coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE 'formatted' END, ''), said) AS content, '"' || replace(replace(replace(to_json(said)[2:len(to_json(said)::VARCHAR) - 1], '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '"' AS script
FROM (SELECT *, trim(replace(said, chr(13) || chr(10), chr(10))) AS p FROM ({_SAID}) s) x""")
def text_renderings(spark, sf_dir):
    t = F.col("said")
    json = F.regexp_extract(text.script_json(F.struct(t.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return rows_of(spark, sf_dir, _SAID, "conversations").select("conv_id", "turn", text.normal_or_null(t).alias("normal"), text.escape_html(t).alias("escaped"), text.preview(t).alias("preview"), text.friendly_error(t).alias("error"), text.content_of(F.when(F.col("turn") % 2 == 0, "").otherwise("formatted"), t).alias("content"), json.alias("script"))


@query(f"""WITH$, {_ENDS}, s AS (SELECT DISTINCT run_id, url FROM ends) SELECT run_id, count(*) AS endpoints, count(*) FILTER (WHERE regexp_matches(url, '(?i)auth|login')) AS auth_like FROM s GROUP BY run_id""")
def run_counters(spark, sf_dir):
    ends = keep(surface.api_endpoints(view(spark, sf_dir, "artifacts")).select("run_id", "url").distinct(), "endpoints")
    return run.counters({"endpoints": ends, "auth_like": ends.where(F.col("url").rlike("(?i)auth|login"))})


_SUMMED = """SELECT o_custkey AS run_id, o_orderkey AS artifact_seq, 'https://h.example.com/' || CAST(o_orderkey % 3 AS STRING) AS url, 'script' AS type, o_orderkey AS size_bytes, 'html:script' AS discovered_from, o_orderkey % 2 = 0 AS formatting_skipped, CAST(NULL AS STRING) AS formatting_note, 'c' || CAST(o_orderkey AS STRING) AS content, 'f' AS formatted_content, o_orderpriority AS summary FROM orders"""


@query(f"""SELECT run_id, artifact_seq, 'artifact-' || row_number() OVER (PARTITION BY run_id ORDER BY artifact_seq) AS id, CASE WHEN formatting_skipped THEN 'fallback' ELSE 'formatted' END AS formatting, content AS raw_preview, first_value(summary) OVER (PARTITION BY run_id, url ORDER BY artifact_seq) AS summary, CASE WHEN artifact_seq % 5 = 0 THEN 'n|m' ELSE '' END AS related_names FROM ({_SUMMED}) s""")
def artifact_manifest(spark, sf_dir):
    rows = rows_of(spark, sf_dir, _SUMMED, "orders")
    related = rows.where("artifact_seq % 5 = 0").select("run_id", "artifact_seq", F.array(F.lit("n"), F.lit("m")).alias("names"))
    return joined(analysis.manifest(rows, rows.select("run_id", "artifact_seq", "summary"), related).select("run_id", "artifact_seq", "id", "formatting", "raw_preview", "summary", "related_names"), "related_names")


_GLOBAL_ROWS = "SELECT user_id, event_id, 'w' || CAST(event_id % 5 AS STRING) || CASE event_id % 3 WHEN 0 THEN 'Captcha' WHEN 1 THEN 'deviceX' ELSE 'plain' END AS name FROM events"


@query(f"""SELECT event_id, array_to_string(list_filter([name, 'app', 'Crypto' || name], x -> regexp_matches(x, '{flows.GLOBALS}'))[1:20], '|') AS globals FROM ({_GLOBAL_ROWS}) g""")
def interesting_globals(spark, sf_dir):
    rows = rows_of(spark, sf_dir, _GLOBAL_ROWS, "events")
    return joined(rows.select("event_id", flows.interesting_globals(F.array(F.col("name"), F.lit("app"), F.concat(F.lit("Crypto"), "name"))).alias("globals")), "globals")

"""Recorded replies of agents, and recorded replies to well-known addresses."""

import json

from pyspark.sql import functions as F

from sparkloom.operators import probes
from sparkloom.plans import agents, run

ORIGIN = "https://s.example.com"


def test_replies_and_fallbacks(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "code", ["scout", "runtime", "synthesizer"]), (1, 1, 1, "more", ["scout", "synthesizer"])], "run_id long, artifact_seq long, chunk_index int, chunk string, agents array<string>")
    rows = agents.tasks(chunks)
    whole = {"summary": "does x", "entryPoints": [{"symbol": "a", "description": "b", "evidence": "c"}], "callGraph": [{"caller": "a", "callee": "b", "rationale": "r"}], "risks": ["r1"]}
    outputs = spark.createDataFrame(
        [(1, 1, 0, "scout", '```json\n{"role":"scout","summary":" first "}\n```'), (1, 1, 0, "runtime", "no json"), (1, 1, 0, "synthesizer", f"Here: {json.dumps(whole)}"), (1, 1, 1, "scout", '{"role":"scout","summary":"second"}')],
        "run_id long, artifact_seq long, chunk_index int, agent string, raw_text string",
    )
    memos = agents.memos(rows, outputs)
    got = {(r.chunk_index, r.agent): (r.failed, r.memo.summary) for r in memos.collect()}
    assert got[0, "scout"] == (False, " first ") and got[1, "scout"] == (False, "second") and got[0, "runtime"][0]
    out = {r.chunk_index: r for r in agents.chunk_analyses(rows, memos, outputs).collect()}
    assert out[0].summary == "does x" and out[0].entryPoints[0].symbol == "a" and not out[0].fell_back and out[1].fell_back and out[1].summary == "second" and out[1].risks == []
    merged = run.merged_analysis(agents.keyed(agents.chunk_analyses(rows, memos, outputs))).collect()
    assert {(r.kind, r.key) for r in merged} == {("entryPoints", "a:b"), ("callGraph", "a->b"), ("risks", "r1")}
    asked = agents.retrieval_queries(rows).where("agent = 'scout' and chunk_index = 0").first()
    assert asked.query.startswith("imports exports") and asked.query.endswith("code ") and asked.exclude == "code"


def test_probes(spark):
    roots = spark.createDataFrame([(1, f"{ORIGIN}/")], "run_id long, url string")
    responses = spark.createDataFrame(
        [
            (f"{ORIGIN}/robots.txt", 200, "Sitemap: /more.xml\nsitemap: https://else.example.com/x.xml"), (f"{ORIGIN}/sitemap.xml", 200, f"<loc>{ORIGIN}/a</loc><loc>https://else.example.com/</loc>"),
            (f"{ORIGIN}/more.xml", 200, f"<loc> {ORIGIN}/b </loc><loc>{ORIGIN}/a</loc>"), (f"{ORIGIN}/openapi.json", 200, '{"openapi":"3","paths":{"/x":{"get":{"summary":"S"}}}}'), (f"{ORIGIN}/openapi.yaml", 200, "openapi: 3"), (f"{ORIGIN}/swagger.json", 404, "{}"),
        ],
        "url string, status int, body string",
    )
    assert [(r.seq, r.url) for r in probes.supplemental_pages(roots, responses).orderBy("seq").collect()] == [(1, f"{ORIGIN}/a"), (2, f"{ORIGIN}/b")]
    docs = probes.openapi_documents(roots, responses).collect()
    assert [(d.url, d.version, d.path_summaries) for d in docs] == [(f"{ORIGIN}/openapi.json", "3", ["GET /x - S"])]
    ends = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    posts = spark.createDataFrame([("u1", 200, '{"data":{"__schema":{"queryType":{"name":"Q"},"types":[]}}}'), ("u2", 403, "")], "url string, status int, body string")
    assert {r.url: r.introspection_status for r in probes.introspected(ends, posts).collect()} == {"u1": "supported", "u2": "blocked", "u3": "failed"} and F is not None

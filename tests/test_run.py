"""Options, and a whole run over recorded responses."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import candidates
from sparkloom.plans import options, run
from sparkloom.plans.options import ConfigError, Options

ROOT = "https://s.example.com/login.html"
JS = """fetch("/api/auth/login", {method: "POST", body: {user: 1}}); const docs = "/openapi.json"; const gq = "/graphql"; query Viewer($id: ID!) { viewer { id } }
navigator.userAgent; screen.width; crypto.subtle.digest("SHA-256", payload); turnstile.render("x"); throw "captcha expired"; localStorage.token = 1"""
HTML = '<title>Login</title><h1>Sign in</h1><form action="/session" method="post"><input name="u" type="email"><button>Log in</button></form><script src="/app.js"></script>'


def test_options(tmp_path):
    got = options.parse(["--url", ROOT, "--max-pages", "3", "--no-local-rag"], {"model": "m", "max_pages": 9})
    assert got == Options(url=ROOT, max_pages=3, local_rag=False, model="m")
    at = tmp_path / "a" / "config.json"
    assert options.read_config(at) is None
    options.save_config(at, got)
    assert stat.S_IMODE(at.stat().st_mode) == 0o600 and options.read_config(at)["model"] == "m"
    for bad in ("{", '{"what": 1}', "[1]"):
        at.write_text(bad)
        with pytest.raises(ConfigError):
            options.read_config(at)
    for bad in ({"url": "ftp://x"}, {"headless": True}, {"max_pages": 0}):
        with pytest.raises(ConfigError):
            Options(**bad)
    assert options.browser_default(Options(url=ROOT)) and not options.browser_default(Options(url=ROOT, headless=True))
    assert [options.retrieval_default(Options(), n) for n in (10, 1_500_000, 2_000_000)] == [False, False, True]
    assert options.concurrency_default(Options(), 5) == 2 and options.codex_mode("x-codex-mini") == "fast" and options.reasoning_effort("reasoning") == "high"
    assert options.same_base_url("HTTPS://A.example/v1/", "https://a.example/v1")


RESPONSES = "url string, status int, content_type string, body string, body_bytes binary"
SITE = "https://s.example.com"


@pytest.fixture(scope="module")
def recorded(spark):
    responses = [
        (ROOT, 200, "text/html", HTML, None), (f"{SITE}/app.js", 200, "application/javascript", JS, None), (f"{SITE}/openapi.json", 200, "application/json", '{"openapi":"3.1","info":{"title":"API"},"paths":{"/x":{"get":{"summary":"List"}}}}', None),
        (f"{SITE}/swagger.json", 200, "application/json", '{"swagger":"2.0","paths":{"/y":{"post":{}}}}', None),
    ]
    requests = [(1, 1, f"{SITE}/session/check", "xhr", None, "Turnstile ready AES", "info", "https://f.example.com/", None, "application/json", '{"ok": true}'), (1, 2, f"{SITE}/collect", "fetch", None, None, None, None, "boom", None, None)]
    session = [(1, "captured", f"{SITE}/login.html?x=1", "<title>Live</title><p>geetest HMAC</p><form><input type=password></form>", ["grecaptcha", "app"], ["sid"], ["jwt"], ["tab"])]
    whole = {"summary": "boots Viewer", "entryPoints": [{"symbol": "boot", "description": "starts", "evidence": "fetch("}], "callGraph": [{"caller": "boot", "callee": "Viewer", "rationale": "r"}], "restoredNames": [{"originalName": "a", "suggestedName": "login", "justification": "j"}], "risks": ["storage"]}
    replies = [(1, 2, 0, "scout", 1, "no json"), (1, 2, 0, "scout", 2, '{"role":"scout","summary":"seen"}'), (1, 2, 0, "synthesizer", 1, json.dumps(whole))]
    frame = spark.createDataFrame
    return {
        "responses": frame(responses, RESPONSES), "posts": frame([(f"{SITE}/graphql", 200, '{"data":{"__schema":{"queryType":{"name":"Q"},"types":[{"kind":"OBJECT","name":"User"}]}}}')], "url string, status int, body string"),
        "requests": frame(requests, "run_id long, seq long, url string, resource_type string, request_body_snippet string, console_text string, console_type string, frame_url string, page_error string, content_type string, response_body string"),
        "session": frame(session, "run_id long, status string, final_url string, page_text string, global_names array<string>, cookie_names array<string>, local_storage_keys array<string>, session_storage_keys array<string>"),
        "replies": frame(replies, "run_id long, artifact_seq long, chunk_index int, agent string, attempt int, raw_text string"),
    }


def test_whole_run(spark, recorded, tmp_path):
    done = run.analyse(Options(url=ROOT, local_rag=True, model="m"), **recorded)
    got = done.collect()
    assert [a["url"] for a in got["artifacts"]] == [f"{SITE}/app.js"] and got["artifacts"][0]["file_name"] == "002-s.example.com-app.js.txt" and [p["url"] for p in got["html_pages"]] == [ROOT]
    assert {e["url"] for e in got["api_endpoints"]} == {f"{SITE}/api/auth/login"} and got["graphql_operations"][0]["variables"] == ["id"]
    # the literal wins over the probed document of the same address; the other probed one is added
    assert [(d["url"], d["source"]) for d in got["openapi_documents"]] == [(f"{SITE}/openapi.json", "artifact-string"), (f"{SITE}/swagger.json", "well-known")]
    assert got["graphql_endpoints"][0]["introspection_status"] == "supported" and got["graphql_endpoints"][0]["sample_fields"] == ["OBJECT:User"]
    auth = got["auth_flows"][0]
    assert auth["steps"][-1]["title"] == "Runtime network activity" and auth["steps"][-1]["evidence"] == ["info: Turnstile ready AES"]
    assert auth["errors"] == ["captcha expired", "boom", "Turnstile ready AES"] and auth["tokens"][-3:] == ["cookie:sid", "localStorage:jwt", "sessionStorage:tab"]
    assert got["trace"]["captcha_providers"] == ["Cloudflare Turnstile", "Google reCAPTCHA", "GeeTest"] and got["trace"]["encryption_hints"] == ["HMAC", "AES"] and got["trace"]["interesting_globals"] == ["grecaptcha"]
    assert got["trace"]["requests"][0]["response_body_snippet"] == '{"ok": true}' and got["trace"]["frame_urls"] == ["https://f.example.com/"]
    assert [c["provider"] for c in got["captcha_flows"]] == ["Cloudflare Turnstile"] * 2 and [f["severity"] for f in got["security_findings"]] == ["medium", "low"]
    assert [s["title"] for s in got["dom_snapshots"]] == ["Login", "Live"]
    # agents: the first reply of the scout was no JSON, the second counts; findings are merged and related
    assert got["status"] == "complete" and got["overview"] == "boots Viewer" and got["analyzed_chunks"] == 1 and [e["symbol"] for e in got["entry_points"]] == ["boot"] and got["risks"] == ["storage"]
    assert [(n["id"], n["type"], n["artifact_urls"]) for n in got["graph_nodes"]] == [("boot", "entry", [f"{SITE}/app.js"]), ("login", "restored", []), ("a", "opaque", []), ("Viewer", "function", [f"{SITE}/app.js"])]
    assert got["manifest"][0]["related_names"] == ["boot", "Viewer"] and got["manifest"][0]["summary"] == "boots Viewer"
    synth = next(p["prompt"] for p in got["prompts"] if p["agent"] == "synthesizer")
    assert '"summary": "seen"' in synth and "Chunk 1 of 1" in synth and f"Artifact URL: {SITE}/app.js" in synth and got["metadata"]["ragSummary"]["segments"] == 1
    assert got["metadata"]["counts"] == {"htmlPages": 1, "artifacts": 1, "chunks": 1, "browserRequests": 2} and got["metadata"]["browserTraceStatus"] == "captured" and got["metadata"]["model"] == "m"
    files = done.write(str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/deterministic-surface.json").read_text())["graphql_endpoints"] and all(f.exists() for f in files)
    told = (tmp_path / "out/report.md").read_text()
    for title in ("Website Surface", "DOM Surface", "Browser-Assisted Trace", "API Surface", "Executive Summary", "Entry Points", "Call Graph", "Restored Names", "Artifact Summaries", "Downloaded Artifacts"):
        assert f"\n## {title}\n" in told
    assert "- `boot` -> `Viewer`: r" in told and "-> 200" not in told and "- GET https://s.example.com/session/check [xhr]" in told and "- pageerror: boom" in told
    page = (tmp_path / "out/report.html").read_text()
    assert '<g data-id="boot"' in page and page.count("<line ") == 1 and '<a href="#artifact-1">' in page and '<tr id="artifact-1">' in page


def test_the_lead_agents_reply_stands_for_the_run(spark, recorded):
    more = spark.createDataFrame([(1, 0, 0, "final", 1, "{"), (1, 0, 0, "final", 2, '{"overview":"a login page","risks":["r"]}')], recorded["replies"].schema)
    got = run.analyse(Options(url=ROOT), recorded["responses"], replies=recorded["replies"].union(more)).collect()
    assert got["overview"] == "a login page" and got["risks"] == ["r"] and got["entry_points"] == [] and got["artifact_summaries"][0]["summary"] == "boots Viewer" and got["status"] == "complete"


def test_run_without_replies_is_partial(spark, recorded, tmp_path):
    done = run.analyse(Options(url=ROOT), recorded["responses"])
    got = done.collect()
    assert got["status"] == "partial" and got["error"] == "1 chunk(s) without a valid analysis" and got["trace"] is None and got["graphql_endpoints"][0]["introspection_status"] == "not-attempted" and got["entry_points"] == []
    files = done.write(str(tmp_path / "my.md"))
    assert files[0] == tmp_path / "my.md" and "## Analysis Status" in files[0].read_text() and (tmp_path / "my-artifacts/browser-trace.json").read_text() == "null\n"


def test_run_of_a_page_alone(spark):
    got = run.analyse(Options(url=ROOT), spark.createDataFrame([(ROOT, 200, "text/html", "<p>x</p>", None)], RESPONSES)).collect()
    assert got["status"] == "complete" and got["overview"] == run.NO_ARTIFACTS and got["artifacts"] == [] and got["api_endpoints"] == []


def test_site_scoped_run_reads_sitemaps(spark):
    root = f"{SITE}/"
    responses = spark.createDataFrame([(root, 200, "text/html", "<p>x</p>", None), (f"{SITE}/sitemap.xml", 200, "text/xml", f"<loc>{SITE}/more</loc>", None), (f"{SITE}/more", 200, "text/html", "<p>y</p>", None)], RESPONSES)
    assert [p["url"] for p in run.analyse(Options(url=root), responses).collect()["html_pages"]] == [root, f"{SITE}/more"]


@pytest.mark.parametrize("rows", [[], [(ROOT, 404, "text/html", "", None)], [(ROOT, 200, "application/pdf", "", None)]])
def test_a_missing_entry_page_fails(spark, rows):
    with pytest.raises(run.EntryError, match="login.html"):
        run.analyse(Options(url=ROOT), spark.createDataFrame(rows, RESPONSES))


def test_failed_trace_keeps_rows_without_signals(recorded):
    failed = run.capped_trace(recorded["requests"], status="failed").first()
    assert failed.frame_urls == ["https://f.example.com/"] and failed.auth_request_urls == [] and failed.encryption_hints == [] and len(failed.requests) == 2 and failed.notes == list(run.NOTES["failed"])


def test_command_line(spark, recorded, tmp_path, capsys):
    from sparkloom.__main__ import main

    for name in ("responses", "replies"):
        recorded[name].write.parquet(f"{tmp_path}/{name}")
    args = ["--url", ROOT, "--responses", f"{tmp_path}/responses", "--output", f"{tmp_path}/out"]
    assert main([*args, "--replies", f"{tmp_path}/replies"], spark) == 0
    said = capsys.readouterr().out
    assert "Status: complete" in said and "REST endpoints: 1" in said and (tmp_path / "out/report.md").exists()
    assert main(args, spark) == 1 and main(["--responses", f"{tmp_path}/responses"], spark) == 2
    assert main(["--url", f"{SITE}/gone", "--responses", f"{tmp_path}/responses"], spark) == 1
    with pytest.raises(SystemExit) as stop:
        main(["--help"])
    assert stop.value.code == 0 and "--max-depth" in capsys.readouterr().out


def test_presets_and_catalog(spark):
    from sparkloom.functions import parsing
    from sparkloom.plans import analysis

    assert options.preset_for("HTTPS://integrate.api.nvidia.com/v1/")["id"] == "nvidia-nim" and options.preset_for("https://else.example.com") is None
    assert options.models_url("https://api.onlysq.ru/ai/openai").endswith("/ai/models") and options.models_url("https://h.example.com/v1/") == "https://h.example.com/v1/models"
    assert parsing.model_entries('{"data": [{"id": "b", "context": "200k"}, {"name": "A"}, {"id": "b", "label": "B"}, 3, {"x": 1}]}') == [{"id": "b", "label": "B", "context": None}, {"id": "A", "label": "A", "context": None}]
    ids = [r.id for r in analysis.sorted_catalog(spark.createDataFrame([("b",), ("a-2",), ("B",), ("A",), ("a",)], "id string")).collect()]
    assert ids == ["a", "A", "a-2", "b", "B"]


def test_names_for_sql(spark):
    run.register(spark)
    assert spark.sql("select url_resolve('/a', 'https://h.example.com/x')").first()[0] == "https://h.example.com/a"
    assert spark.sql("select size(chunk_text('aaaa', 2))").first()[0] == 2


def test_table_functions_for_sql(spark):
    run.register(spark)
    scripts = [(1, JS + ' import x from "./b.js"; import("./b.js"); new Worker("/w.js?x=é"); "/m.wasm" "/i.png" "http://[bad/a.js" //# sourceMappingURL=a.map'), (2, None), (3, 'new Worker("./c.mjs"); export * from `/page.html`;')]
    frame = spark.createDataFrame([(k, "https://h.example.com/d/a.js", c) for k, c in scripts], "k int, base_url string, content string")
    frame.createOrReplaceTempView("scripts")
    got = [tuple(r) for r in spark.sql("SELECT k, c.seq, c.url, c.type FROM scripts, LATERAL js_candidates(content, base_url) c").collect()]
    want = [tuple(r) for r in candidates.js_candidates(frame, F.lit("x"), "k").select("k", "seq", "url", "type").collect()]
    assert sorted(got) == sorted(want) and len(got) > 5
    page = spark.sql("""SELECT r.* FROM (SELECT '<script src="/a.js"></script><a href="/b">b</a><script>1</script>' AS html), LATERAL html_references(html) r""").collect()
    assert [tuple(r) for r in page] == [(0, "/a.js", "html:script"), (1, "/b", "html:a")]


def test_counters_of_tables(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "run_id long"), spark.createDataFrame([(2,), (3,)], "run_id long")
    assert {tuple(r) for r in run.counters({"a": a, "b": b}).collect()} == {(1, 2, 0), (2, 1, 1), (3, 0, 1)}


def test_chunk_tasks(spark):
    rows = spark.createDataFrame([(1, 1, "high", "a" * 200_000), (1, 2, "low", "b")], "run_id long, artifact_seq long, priority string, content string")
    got = {(r.artifact_seq, r.chunk_index): r.agents for r in run.chunk_tasks(rows, 1000).collect()}
    assert got == {(1, 0): ["scout", "runtime", "naming", "security", "synthesizer"], (1, 1): ["runtime", "security", "synthesizer"], (1, 2): ["runtime", "security", "synthesizer"], (2, 0): ["scout", "synthesizer"]}


def test_merged_analysis(spark):
    rows = spark.createDataFrame([(1, 1, 0, [("a", "1"), ("b", "2")]), (1, 1, 1, [("a", "3"), ("c", "4")])], "run_id long, artifact_seq long, chunk_index int, risks array<struct<key:string,value:string>>")
    got = [(r["rank"], r.key, r.value) for r in run.merged_analysis(rows).orderBy("rank").collect()]
    assert got == [(1, "a", "1"), (2, "b", "2"), (3, "c", "4")]

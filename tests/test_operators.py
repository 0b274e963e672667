"""Fixtures with expected values for operators that the test tables exercise little."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import parsing, text, urls
from sparkloom.operators import candidates, dom, flows, ordered, planner, retrieval
from sparkloom.plans import crawl, report

PAGE = "https://site.example.com/login.html"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_chunks_of_short_functions():
    source = "".join(f"function f{k}() {{ return {k}; }}\n" for k in range(5))
    chunks = parsing.chunk_text(source, 50)
    assert "".join(chunks) == source and all(len(c.encode()) <= 50 for c in chunks)


def plain_chunks(source, most):
    """Character by character: as many as fit, one at least, then back to the last separator beyond six tenths."""
    out, at = [], 0
    while at < len(source):
        end = min(len(source), at + most)
        while end > at + 1 and len(source[at:end].encode()) > most:
            end -= 1
        if end < len(source):
            for k in range(end - 1, at + max(1, int((end - at) * 0.6)) - 1, -1):
                if source[k] in "\n;} ,":
                    end = k + 1
                    break
        out.append(source[at:end])
        at = end
    return out


@given(st.text(alphabet="ab ,;}\né😀", max_size=300), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_chunks_against_a_plain_version(source, most):
    assert parsing.chunk_text(source, most) == plain_chunks(source, most)


@given(st.text(max_size=300), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_chunks_lose_nothing(source, most):
    chunks = parsing.chunk_text(source, most)
    assert "".join(chunks) == source
    assert all(len(c.encode()) <= most or len(c) == 1 for c in chunks)


@pytest.mark.parametrize(("reply", "want"), [('```json\n{"a": 1}\n```', '{"a":1}'), ('Sure: {"a": "}"} ok', '{"a":"}"}'), ("{broken", None), ("", None), (None, None)])
def test_json_repair(reply, want):
    assert parsing.repair_json(reply) == want


@pytest.mark.parametrize(("meta", "want"), [('{"limits":{"context":"512k"}}', 512000), ('{"tags":["context 128k"]}', 128000), ('{"context_window":272000,"max_tokens":4096}', 272000), ("no json", None)])
def test_context_window(meta, want):
    assert parsing.context_window(meta) == want


def test_wasm_imports_and_exports():
    module = b"\0asm\1\0\0\0" + bytes([1, 4, 1, 0x60, 0, 0]) + bytes([2, 9, 1, 3]) + b"env" + bytes([1]) + b"f" + bytes([0, 0]) + bytes([7, 8, 1, 4]) + b"main" + bytes([0, 0])
    assert parsing.wasm_interface(module) == (["env.f (function)"], ["main (function)"])
    assert "unavailable" in parsing.wasm_text("u", b"abc")


@pytest.mark.parametrize(
    ("reference", "want"),
    [("a b.js", "https://site.example.com/x/a%20b.js"), ("/é", "https://site.example.com/%C3%A9"), ("//H.Example.com:443", "https://h.example.com/"), ("HTTPS://A.com", "https://a.com/"), ("..\\q", "https://site.example.com/q"), ("mailto:x@y", "mailto:x@y")],
)
def test_resolve(reference, want):
    assert urls.resolve(reference, "https://site.example.com/x/y") == want


@pytest.mark.parametrize("reference", ["", "data:text/js,1", "blob:x", "#top", "logo.PNG?x=1", None, "http://[bad"])
def test_candidates_to_reject(reference):
    assert urls.resolve_candidate(reference, PAGE) is None


def test_renderings(spark):
    got = spark.range(1).select(
        *(text.duration(F.lit(ms)) for ms in (8000, 102000, 7560000)), text.remaining_ms(F.lit(2), F.lit(6), F.lit(20000)), text.remaining_ms(F.lit(0), F.lit(6), F.lit(20000)), text.remaining_ms(F.lit(6), F.lit(6), F.lit(20000)),
        text.file_name(F.lit("a b//c")), text.file_name(F.lit("")), text.escape_html(F.lit("<&\"'>")), text.token_estimate(F.lit("12345678")), text.token_estimate(F.lit("  ")), planner.chunk_bytes(F.lit(128000)), planner.chunk_bytes(F.lit(10)), text.middle_truncate(F.lit("abcdef"), 3),
    ).first()
    assert list(got) == ["8s", "1m 42s", "2h 6m", 40000, None, None, "a-b-c", "artifact", "&lt;&amp;&quot;&#39;&gt;", 2, 0, 115200, 81920, "abc"]


def test_ascii_word_boundaries(spark):
    got = spark.range(1).select(F.lit("ñauth").rlike(flows.AUTH), F.lit("xauth").rlike(flows.AUTH), text.squeeze(F.lit(" a  b "))).first()
    assert list(got) == [True, False, "a b"]


def test_offsets_count_code_points(spark):
    got = spark.createDataFrame([('x😀 "/api/a" é "/api/b"',)], ["c"]).select(ordered.match_offsets(F.col("c"), '"(/api/[a-z])"')).first()[0]
    assert got == [3, 14]


def test_html_candidates(spark):
    html = """<link rel=stylesheet href=a.css><link rel=modulepreload href=/m.js><script src="/app.js"></script><script>navigator.serviceWorker.register("/sw.js"); fetch("/x.wasm"); fetch("/i.png")</script>
    <a href="/next">n</a><a href="https://other.example.com/">o</a><iframe src="/frame.html"></iframe><form action="/auth"></form>"""
    pages = spark.createDataFrame([(1, PAGE, html)], ["run_id", "url", "html"])
    got = {(r.url.removeprefix("https://site.example.com"), r.type, r.discovered_from) for r in candidates.html_candidates(pages, "run_id").collect()}
    assert got == {("/m.js", "script", "html:preload"), ("/app.js", "script", "html:script"), ("/sw.js", "service-worker", "html:inline-script"), ("/x.wasm", "wasm", "html:inline-script"), ("/next", "html", "html:a"), ("/frame.html", "html", "html:iframe"), ("/auth", "html", "html:form")}


def test_nested_filter(spark):
    rows = [("https://s.example.com/login.html", "html", "html:a", True), ("https://s.example.com/other", "html", "html:a", False), ("https://s.example.com/f", "html", "html:iframe", True), ("https://s.example.com/find", "html", "html:form", False), ("https://s.example.com/signup", "html", "html:form", True), ("https://s.example.com/login/help", "html", "html:a", True), ("https://s.example.com/a.js", "script", "html:script", True)]
    df = spark.createDataFrame(rows, ["url", "type", "discovered_from", "want"])
    got = df.withColumn("got", candidates.nested_filter(df, F.lit("https://s.example.com/login.html"), F.lit("page"))).collect()
    assert all(r.got == r.want for r in got)


def test_dom_snapshot():
    html = """<title> Sign  in </title><meta name=description content="d"><h2>two</h2><h1>one</h1><script>window.__BOOT__=1; window.STATE_X=2</script>
    <form action="/go" method=post data-testid=f><input name=user type=email><input name=p type=password><button>Go</button></form><iframe src="/f"></iframe><a href="/x">link</a>"""
    got = dom.snapshot(html, PAGE)
    assert got["headings"] == ["one", "two"] and got["title"] == "Sign in" and got["description"] == "d"
    assert got["forms"] == [{"action": "https://site.example.com/go", "method": "POST", "input_names": ["user", "p"], "input_types": ["email", "password"], "submit_labels": ["Go"]}]
    assert got["inline_state_hints"] == ["global:STATE_X", "global:__BOOT__"] and got["data_attribute_keys"] == ["testid"]
    assert got["summary"] == 'title "Sign in", 2 heading(s), 1 form(s), 1 button label(s), 1 iframe(s), 2 inline state hint(s)'
    assert dom.snapshot(None, None)["summary"] == "Minimal DOM surface detected."


def test_dom_of_broken_pages(monkeypatch):
    import time

    start = time.perf_counter()
    assert len(dom.snapshot("<a href=x>t" * 90_000 + "</i>" * 90_000, PAGE)["links"]) == 20
    assert len(dom.snapshot("<form><input name=a>" * 20_000, PAGE)["forms"]) == 20_000 and time.perf_counter() - start < 8
    monkeypatch.setattr(dom._Tree, "handle_data", lambda *a: (_ for _ in ()).throw(ValueError("broken")))
    assert dom.snapshot("<title>x</title><script>window.STATE=1</script>", PAGE)["summary"] == "Fallback DOM snapshot with 1 inline state hint(s)"
    assert dom.snapshot("x<p>", PAGE) == dom.snapshot("y<p>", None) and dom.snapshot("x", PAGE)["summary"] == "Fallback DOM snapshot only."


REFERENCES = ["/a.js", "//cdn.example.com/b.js", "./c.js", "d/e.js?x=1#y", "../f.js", "g h.js", "HTTPS://Up.example.com/i.js", "https://h.example.com/j.js", "https://h.example.com", "https://h.example.com:8443/k.js", "/l/../m.js", "n//o.js", "mailto:x", "", "data:x", "#p", "/q.png", "r.é", "?s", "/t\\u.js", "javascript:void(0)", "/v.js#", "/v.js?", "v.js?#", "w:x", ".hidden/y", "/a.js"]


@pytest.mark.parametrize("base", [PAGE, "https://site.example.com/deep/er/page?q=1", "https://site.example.com", "HTTPS://Site.example.com:443/x", "https://site.example.com/a//b/c"])
def test_script_references_resolve_as_in_python(spark, base):
    content = "; ".join(f'import("{r}")' for r in REFERENCES if r)
    got = candidates.js_candidates(spark.createDataFrame([(1, base, content)], ["a", "base_url", "content"]), F.lit("script:code"), "a").orderBy("seq").collect()
    assert [r.url for r in got] == list(dict.fromkeys(u for r in REFERENCES if r and (u := urls.resolve_candidate(r, base))))


def test_matches_of_several_patterns_in_one_row(spark):
    df = spark.createDataFrame([(1, "a1 \x01 b2 a3"), (2, "none"), (3, None)], ["k", "content"])
    got = [tuple(r) for r in ordered.matches(df, "content", ["a([0-9])", "(b)([0-9])"], {"g": 1}, "k", windows={"near": (1, 2)}).collect()]
    assert got == [(1, 0, 0, 0, "1", "a1"), (1, 0, 1, 8, "3", " a3"), (1, 1, 0, 5, "b", " b2")]


def test_crawl_with_budgets(spark):
    root = "https://s.example.com/"
    js = "application/javascript"
    responses = [
        (root, 200, "text/html", '<script src="/a.js"></script><a href="/p1">1</a><a href="/p2">2</a><a href="/gone">3</a>', None), (root + "a.js", 200, js, 'import "./b.js"; //# sourceMappingURL=a.map', None), (root + "b.js", 200, js, "1", None),
        (root + "a.map", 200, "application/json", '{"sources":["x.ts"]}', None), (root + "p1", 200, "text/html", '<a href="/p3">3</a>', None), (root + "p2", 200, "text/html", "", None), (root + "p3", 200, "text/html", "", None), (root + "gone", 404, "text/html", "", None),
    ]
    responses = spark.createDataFrame(responses, "url string, status int, content_type string, body string, body_bytes binary")
    roots = spark.createDataFrame([(1, root)], ["run_id", "url"])
    names = lambda **how: {(r.depth, r.url.removeprefix(root)) for r in crawl.crawl(roots, responses, **how).where("ok").collect()}
    assert names() == {(0, ""), (1, "a.js"), (1, "p1"), (1, "p2"), (2, "b.js"), (2, "a.map"), (2, "p3")}
    assert names(max_pages=2) == {(0, ""), (1, "a.js"), (1, "p1"), (2, "b.js"), (2, "a.map")}
    assert names(max_artifacts=1) == {(0, ""), (1, "a.js")}
    assert names(max_depth=1) == {(0, ""), (1, "a.js"), (1, "p1"), (1, "p2")}


def test_retrieval(spark):
    content = "function renderDashboard() { return 1 }\nconst token = localStorage.getItem('t');\nsession = auth(token)\n"
    segs = retrieval.segment_rows(spark.createDataFrame([(1, content)], ["a", "content"]), "content", "a", size=40)
    asked = spark.createDataFrame([(1, 0, "token localStorage auth session", "renderDashboard")], ["a", "query_id", "query", "exclude"])
    got = retrieval.with_segments(retrieval.top_segments(segs, asked, "a", k=2), segs, "a").orderBy("rank").collect()
    assert got and all("token" in r.segment and "renderDashboard" not in r.segment for r in got)
    open_ = retrieval.with_segments(retrieval.top_segments(segs, asked.withColumn("query", F.lit("renderDashboard token")).withColumn("exclude", F.lit(None).cast("string")), "a", k=9), segs, "a").collect()
    assert any("renderDashboard" in r.segment for r in open_) and [r.score for r in sorted(open_, key=lambda r: r["rank"])] == sorted((r.score for r in open_), reverse=True)


def test_planner(spark):
    rows = [("https://s.example.com/auth/login.js", "worker", "html:script", 10), ("https://www.google.com/search.js", "script", "html:a", 10)]
    df = spark.createDataFrame(rows, ["url", "type", "discovered_from", "size_bytes"]).withColumn("target_url", F.lit("https://s.example.com/auth/login.html"))
    got = {r.url: (r.score, r.priority) for r in planner.relevance(df).collect()}
    assert got == {rows[0][0]: (26, "high"), rows[1][0]: (-11, "low")}


def test_report(tmp_path):
    run = {"url": "https://s.example.com/", "artifacts": [{"url": "u", "file_name": "001-a.txt", "content": "x"}], "security_findings": [{"severity": "low", "title": "</script>"}]}
    files = report.write_run(run, tmp_path / "run")
    assert all(f.exists() for f in files) and (tmp_path / "run/browser-trace.json").read_text() == "null\n"
    assert "</script>\"" not in report.json_for_script(run) and "## API Surface\n\n- No REST-like endpoints were extracted." in report.markdown(run)
    assert report.run_directory("https://h.example.com", "out/a.md").name == "a-artifacts"
    assert report.surface({"auth_flows": [{"title": "t", "tokens": None}]})["auth_flows"] == [{"triggers": [], "steps": [], "tokens": [], "errors": [], "title": "t"}] and set(report.surface({})) == set(report.SURFACE)
    assert report.write_report(run, tmp_path / "alone/my.md").read_text().startswith("# Front-end report")
    assert "- [low] </script>" in (tmp_path / "run/README.md").read_text()
    trace = {"status": "captured", "requests": [{"method": "POST", "url": f"u{k}", "resource_type": "xhr", "status": 200, "request_body_snippet": "b"} for k in range(30)], "console_lines": ["log: hi: there"], "page_errors": ["e"]}
    told = report.markdown(run | {"trace": trace, "openapi_documents": [{"url": "d", "path_summaries": [str(k) for k in range(9)]}]})
    assert told.count("- POST u") == 20 and "- POST u0 [xhr] -> 200 body: b" in told and "- [log] hi: there\n- pageerror: e" in told and "- d: 0; 1; 2; 3; 4\n" in told


def test_report_page_draws_nodes_edges_and_links():
    run = {
        "url": "https://s.example.com/<x>", "overview": "<b>", "call_graph": [{"caller": "a", "callee": "b", "rationale": "r"}, {"caller": "a", "callee": "gone", "rationale": "r"}], "graph_nodes": [{"id": i, "type": "entry", "meta": "", "x": 120, "y": 44, "artifact_urls": []} for i in "ab"],
        "api_endpoints": [{"url": "/e", "methods": [], "purpose": "p", "request_fields": [], "source_artifact_url": "u"}], "auth_flows": [{"title": "t", "steps": [{"endpoints": ["/e", "/f"]}]}],
        "manifest": [{"id": "artifact-1", "url": "u", "type": "script", "formatting": "formatted", "formatting_note": None, "raw_preview": "</pre>", "related_names": ["a"]}],
    }
    page = report.html_page(run)
    assert page.count("<g data-id=") == 2 and page.count("<line ") == 1 and "<b></p>" not in page and "&lt;/pre&gt;" in page and page.count('<a href="#artifact-1">') == 2
    data = report.embedded(run)
    assert data["surface"]["auth_flows"][0]["id"] == "auth-flow-1" and data["surface"]["auth_flows"][0]["related_artifact_urls"] == ["u"]


def test_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from sparkloom.sources import store

    no_dir = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=no_dir, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(session)

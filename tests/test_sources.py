"""Captures, stored indexes and names in summaries."""

import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval
from sparkloom.plans import analysis
from sparkloom.sources.har import entry_urls, har
from sparkloom.sources.store import keep


def entry(url, method="GET", status=200, kind="text/html", text=None, post=None, **more):
    content = {"mimeType": kind, "size": len(text or "")} | ({} if text is None else {"text": text}) | {k: v for k, v in more.items() if k == "encoding"}
    return {"request": {"method": method, "url": url} | ({"postData": {"text": post}} if post else {}), "response": {"status": status, "content": content}, "_resourceType": more.get("kind", "document")}


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    at = tmp_path_factory.mktemp("har")
    site = "https://a.example.com"
    first = [
        entry(f"{site}/login.html", text='<title>In</title><script src="/app.js"></script>'), entry(f"{site}/app.js", kind="application/javascript", text=base64.b64encode('fetch("/api/é")'.encode()).decode(), encoding="base64"),
        entry(f"{site}/m.wasm", kind="application/wasm", text=base64.b64encode(b"\0asm\1\0\0\0").decode(), encoding="base64"), entry(f"{site}/graphql", "POST", kind="application/json", text="{}", post="{query}", kind_="x"),
        entry(f"{site}/app.js", kind="application/javascript", text="later()"), entry("", text="x"), {"request": {"url": f"{site}/lost"}, "response": None},
    ]
    (at / "1.har").write_text(json.dumps({"log": {"entries": first}}))
    (at / "2.har").write_text("﻿" + json.dumps({"log": {"entries": [entry("https://b.example.com/", text="<title>B</title>")]}}))
    (at / "notes.txt").write_text("no capture")
    return str(at)


def test_captures_are_tables(spark, captures):
    rows = {(r.run_id, r.url): r for r in har(spark, captures, "responses").collect()}
    assert len(rows) == 5 and rows[1, "https://a.example.com/app.js"].body == "later()" and rows[1, "https://a.example.com/m.wasm"].body_bytes == b"\0asm\1\0\0\0" and rows[1, "https://a.example.com/lost"].status is None
    assert [tuple(r) for r in har(spark, captures, "posts").collect()] == [(1, "https://a.example.com/graphql", 200, "{}")]
    asked = har(spark, captures, "requests").where("run_id = 1").orderBy("seq").collect()
    assert [r.seq for r in asked] == [1, 2, 3, 4, 5, 7] and asked[1].response_body == 'fetch("/api/é")' and asked[3].request_body_snippet == "{query}"
    assert har(spark, captures, "requests").rdd.getNumPartitions() == 2
    few = har(spark, captures, "responses", ["url", "status"])
    assert few.columns == ["url", "status"] and few.count() == 5
    assert {tuple(r) for r in entry_urls(spark, captures).collect()} == {(1, "https://a.example.com/login.html"), (2, "https://b.example.com/")}


def test_columns_not_asked_for_are_not_decoded(spark, tmp_path):
    (tmp_path / "x.har").write_text(json.dumps({"log": {"entries": [entry("https://x.example.com/", text="!!not base64!!", encoding="base64")]}}))
    assert har(spark, str(tmp_path), "responses", ["url"]).first().url == "https://x.example.com/"
    with pytest.raises(Exception, match="no capture: x.har"):
        har(spark, str(tmp_path), "responses").collect()


@pytest.mark.parametrize("text", ["{", "[]", '{"log": {}}', '{"log": {"entries": [3]}}'])
def test_what_is_no_capture_is_named(spark, tmp_path, text):
    (tmp_path / "bad.har").write_text(text)
    with pytest.raises(Exception, match="no capture: bad.har"):
        har(spark, str(tmp_path), "requests").collect()


def test_command_line_of_captures(spark, captures, tmp_path, capsys):
    from sparkloom.__main__ import main

    assert main(["--captures", captures, "--output", f"{tmp_path}/o"], spark) == 0
    assert "Runs: 2" in capsys.readouterr().out
    told = (tmp_path / "o/run_id=1/report.md").read_text()
    assert "https://a.example.com/app.js" in told and json.loads((tmp_path / "o/run_id=2/browser-trace.json").read_text())["status"] == "captured"


def test_a_stored_index_serves_batches_without_its_exchange(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "x1", "y2"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)], "doc_id long, text string")
    segs = retrieval.segment_rows(docs, "text", "doc_id", size=80)
    index = retrieval.Index(segs, "doc_id")
    for n in (0, 1):
        asked = docs.select("doc_id", F.lit(n).alias("query_id"), F.substring("text", 20 * n + 1, 60).alias("query"), (F.substring("text", 81, 30) if n else F.lit(None).cast("string")).alias("exclude"))
        want = sorted(map(tuple, retrieval.top_segments(segs, asked, "doc_id").collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            out = index.top(asked)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, out.collect())) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        initial = plan.split("== Initial Plan ==")[-1]
        scans = [m.start() for m in re.finditer(r"Scan parquet spark_catalog\.default\.sparkloom_(terms|segments)", initial)]
        for at in scans:  # up from each scan of the index: its join comes before any exchange
            above = initial[:at].splitlines()[::-1]
            depth = len(above[0]) - len(above[0].lstrip(" :+-*("))
            for line in above[1:]:
                d = len(re.match(r"[ :+\-*(0-9)]*", line)[0])
                if d < depth:
                    depth = d
                    assert "Exchange" not in line, line
                    if "Join" in line:
                        break
        assert scans
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in index.names]


def test_names_in_summaries_equal_all_pairs(spark):
    rng = random.Random(3)
    letters = "abcAB_$ é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    names = [(run, k, rng.choice([word(rng.randint(0, 6)), word(2), "boot", "Boot", None])) for run in (1, 2) for k in range(60)]
    texts = [(run, k, f"https://h.example.com/{word(5)}-boot.js", rng.choice([None, "", word(30), word(60), "boot " + word(9)])) for run in (1, 2, 3) for k in range(25)]
    got = analysis.artifact_relations(spark.createDataFrame(texts, "run_id int, artifact_seq int, url string, summary string"), spark.createDataFrame(names, "run_id int, name_seq int, name string"), most=4)
    want = set()
    for run, seq, url, summary in texts:
        tokens = {t for x in (summary or "", url) for t in re.findall(r"[a-z_$][a-z0-9_$-]{2,}", x.lower())}
        told = [n for r, _, n in names if r == run and n is not None and (n.lower() in tokens or n in (summary or ""))][:4]
        if told:
            want.add((run, seq, tuple(dict.fromkeys(told))))
    assert {(r.run_id, r.artifact_seq, tuple(r.names)) for r in got.collect()} == want


def test_ten_thousand_names_meet_by_their_pieces(spark):
    names = spark.range(10_000).selectExpr("1 as run_id", "id as name_seq", "concat('fn', hex(id * 7919)) as name")
    texts = spark.range(400).selectExpr("1 as run_id", "id as artifact_seq", "'https://h.example.com/a.js' as url", "concat('calls fn', hex(id * 25 * 7919), ', and more') as summary")
    names, texts = keep(names, "names"), keep(texts, "texts")  # else the planner sees that all are of one run
    out = analysis.artifact_relations(texts, names)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.artifact_seq: r.names for r in out.collect()}
    assert len(got) == 400 and all(f"fn{k * 25 * 7919:X}" in names_ for k, names_ in got.items())

"""What reviews found: each test failed before its change."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import flows, ordered, surface
from sparkloom.plans import analysis, queries


def test_long_numbers_stay_whole_in_file_names(spark):
    rows = spark.createDataFrame([(7,), (999,), (1000,), (12820,)], "n int")
    got = [r[0] for r in rows.select(analysis.manifest_name(F.col("n"), F.lit("https://h.example/a.js"), F.lit("script"))).collect()]
    assert got == ["007-h.example-a.js.txt", "999-h.example-a.js.txt", "1000-h.example-a.js.txt", "12820-h.example-a.js.txt"]


def test_open_references_of_a_page_stay_as_its_sql_has_them(spark, tmp_path):
    from oracle import check

    rows = [(k, "https://h.example/", f"<html><head><title>{t}</title></head><body><h1>{t}</h1></body></html>") for k, t in enumerate(["a &amp;&amp", "&amp;lt; &lt;b&gt;", "x &copy y &#65; &nbsp;z", "&quot;q&quot; & r"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    check(spark, queries.page_dom_snapshot, queries.ORACLES["page_dom_snapshot"], str(tmp_path))


def test_space_and_names_as_the_plain_patterns_have_them(spark):
    rng = random.Random(6)
    pieces = [" ", "  ", "\t", "\n ", " \u00a0", "\u2003", "\ufeff", "é", "a", "b9", "9c", "$x", ":", " :", "_", "k" * 40, "k" * 41, "9" + "z" * 45, "{", "É: "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old_keys = F.slice(F.regexp_extract_all("t", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]{1,40})\s*:"), 1), 1, 8)
    for r in df.select("t", text.squeeze(F.col("t")).alias("s"), F.trim(F.regexp_replace("t", f"{text.WS}+", " ")).alias("s0"), surface.nearby_keys(F.col("t")).alias("k"), old_keys.alias("k0")).collect():
        assert (r.s, r.k) == (r.s0, r.k0), r.t


@pytest.mark.parametrize("name, most", [("runtime_merge", 8), ("fingerprint_signals", 3), ("encryption_signals", 3), ("captcha_flows", 3), ("auth_flow", 3), ("security_findings", 6), ("flow_relations", 0), ("api_endpoints", 1)])
def test_artifacts_are_searched_once_for_what_a_query_needs(spark, name, most):
    """No text is searched in a filter, and artifacts are scanned no more often than a query has lists of them."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [line for line in plan if re.match(r"[\s:|+-]*Filter", line)]
    assert not [f for f in filters if "regexp_extract_all" in f or "regexp_replace" in f]
    assert sum("Relation" in line and ("content" in line or "o_orderkey" in line) for line in plan) <= most


def _plan(spark, name):
    return queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()


def test_pages_are_parsed_by_many_tasks(spark):
    assert queries.QUERIES["form_snapshots"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_analyses_are_computed_once_to_be_merged(spark):
    assert _plan(spark, "merged_findings").optimizedPlan().toString().count("ArrowEvalPython") <= 4


def test_probes_broadcast_no_side(spark):
    assert "BroadcastHashJoin" not in _plan(spark, "openapi_probes").executedPlan().toString()


def test_replies_are_dealt_out_before_they_are_sorted(spark):
    assert "SortAggregate" not in _plan(spark, "best_replies").executedPlan().toString()


def test_artifacts_are_searched_by_plain_strings_before_patterns(spark):
    for name in ("fingerprint_signals", "encryption_signals", "captcha_flows", "auth_flow"):
        assert "regexp_extract_all(lower(content" not in _plan(spark, name).optimizedPlan().toString()
    got = flows.scanned(spark.createDataFrame([("Canvas AES",)], "content string"), *flows.FINGERPRINT_NEEDLES).first()
    assert got.held == ["canvas"]


def test_faster_searches_find_what_the_plain_ones_find(spark):
    rng = random.Random(7)
    pieces = ["fetch(", "Axios.get(", "axios.post(", "URL : ", "baseurl:", "f", "a", "u", "b", '"/api/x"', "'/V2/y'", '"/rest/é"', "`/graphql`", '"', "\n", "post", " PUT", "é", "😀", "x" * 85, "\x01"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = F.filter(F.array(*map(F.lit, surface.METHODS)), lambda m: F.upper(F.col("t")).contains(m))
    all_of = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    for r in df.select("t", all_of(surface.REST_SEARCH).alias("a"), all_of(surface.REST_PATTERN).alias("b"), ordered.match_offsets(F.col("t"), surface.REST_SEARCH).alias("at"), surface.method_hints(F.col("t")).alias("m"), names.alias("n")).collect():
        assert r.a == r.b and r.m == r.n, r.t
        assert [r.t[k : k + len(m)] for k, m in zip(r["at"], r.a, strict=True)] == r.a, r.t


def test_fields_and_evidence_are_taken_of_unique_endpoints_alone(spark):
    plan = _plan(spark, "api_endpoints").optimizedPlan().toString().split("\n")
    keys = [k for k, line in enumerate(plan) if "{1,40}" in line]
    windows = [k for k, line in enumerate(plan) if re.match(r"[\s:|+-]*Window ", line)]
    assert len(keys) == 1 and sum(k < keys[0] for k in windows) == 1 and len(windows) == 2


def _texts(rng, pieces, n=400, most=40):
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_few_matches_are_located_as_the_folds_locate_them(spark):
    rng = random.Random(10)
    texts = _texts(rng, ["fetch(", "axios.get(", '"/api/x"', "'/v2/x'", "/api/x", '"', "\n", "é", "😀", "\x01", "x" * 85], most=14) + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    patterns = [surface.REST_SEARCH, surface.API_PATTERN]
    got = {(r.k, r.pattern, r.match_seq): (r.pos, r.m) for r in ordered.matches(df, "t", patterns, {"m": 0}, "k").collect()}
    want = {}
    for p, pattern in enumerate(patterns):
        for r in df.where("t is not null").select("k", ordered.match_offsets(F.col("t"), pattern).alias("at"), F.regexp_extract_all("t", F.lit(pattern), 0).alias("m")).collect():
            want |= {(r.k, p, n): x for n, x in enumerate(zip(r["at"], r.m, strict=True))}
    assert got == want and {n for _, _, n in want} >= {0, 1, 2, 3}
    plan = ordered.matches(df, "t", patterns, {"m": 0}, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "position(" in plan or "locate(" in plan


def test_words_are_found_by_their_first_letters_as_without_them(spark):
    rng = random.Random(11)
    words = (flows.AUTH, flows.ENCRYPTION_IN, flows.ENCRYPTION_OUT, *(p for _, p in (*flows.ENCRYPTION, *flows.CAPTCHA)))
    assert all("(?=[" in text.quick(p) for p in words[:3]) and text.quick(flows.ENCRYPTION[0][1]) == flows.ENCRYPTION[0][1]
    texts = _texts(rng, ["token", "Password", "2FA", "_", " ", "-", "é", "K", "AES", "sha-256", "SHA-2567", "digest", "9", "turnstile", "hash", "FUNCAPTCHA", "İ", "ſession", "session"])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    all_of = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    for r in df.select(F.array(*(all_of(p) for p in words)).alias("a"), F.array(*(all_of(text.quick(p)) for p in words)).alias("b")).collect():
        assert r.a == r.b


@pytest.mark.parametrize("name, searched", [("encryption_signals", "ciphertext"), ("captcha_flows", "too many")])
def test_texts_with_several_rules_are_searched_once(spark, name, searched):
    """What is taken of a text is taken before its rules become rows."""
    plan = _plan(spark, name).optimizedPlan().toString().split("\n")
    lines = [k for k, line in enumerate(plan) if searched in line and "regexp_extract_all" in line]
    assert lines and all("Project" in plan[k] for k in lines)
    rules = [k for k, line in enumerate(plan) if "Generate explode(found" in line or "Generate explode(rules" in line]
    assert rules and any(k > rules[0] for k in lines)


def test_tokens_are_counted_without_shuffling_them(spark):
    from sparkloom.operators import retrieval

    rows = [(1, 0, "a1 b2 a1 A1 x"), (1, 0, "b2 c3"), (1, 1, ""), (2, 0, None), (None, 0, "zz zz"), (None, 0, "zz"), (3, 0, "!")]
    segs = spark.createDataFrame(rows, "doc_id long, segment_index int, segment string")
    out = retrieval.term_weights(segs, "doc_id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, "a1", 3), (1, 0, "b2", 2), (1, 0, "c3", 1), (None, 0, "zz", 3)], key=str)
    plan = _plan(spark, "rag_term_weights").executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "token" not in "".join(line for line in plan.split("\n") if "Exchange" in line)
    filters = [line for line in _plan(spark, "rag_term_weights").optimizedPlan().toString().split("\n") if re.match(r"[\s:|+-]*Filter", line)]
    assert not [f for f in filters if "regexp_extract_all" in f or "sort_array" in f]


def test_an_index_shuffles_texts_and_no_tokens(spark):
    from sparkloom.operators import retrieval

    rng = random.Random(11)
    words = ["alpha", "Beta", "a.b", "$x", "é", "x", "ſ1", "K2", "-", "y2 "]
    text_of = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k % 9 or None, text_of(rng.randint(0, 40))) for k in range(30)] + [(20, ""), (21, None), (22, "alpha " * 900)]  # keys that repeat, and none
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    segs = retrieval.segment_rows(docs, "text", "doc_id", size=50)
    asked = docs.select("doc_id", F.length("text").alias("query_id"), "text", F.substring("text", 3, 40).alias("query"), F.expr("if(length(text) % 3 = 0, concat(' ', substring(text, 60, 8), '  '), if(length(text) % 3 = 1, ' ', null))").alias("exclude"))
    asked = asked.unionByName(asked.where("doc_id = 22").withColumn("query", F.lit("zz")).withColumn("query_id", F.lit(1))).drop("text")
    index = retrieval.Index(segs, "doc_id")
    out = index.top(asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "token#" not in plan
    want = sorted(map(tuple, retrieval.top_segments(segs, asked, "doc_id").select(out.columns).collect()))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 30
    index.drop()


def test_a_page_is_parsed_once_in_small_batches(spark):
    from sparkloom.operators import candidates

    plan = _plan(spark, "page_links").executedPlan().toString()
    assert len(re.findall(r"(?:Batch|Arrow)EvalPython \[html_references", plan)) == 1 and "ArrowEvalPython [html_references" not in plan  # no batches that grow with the input
    assert len(re.findall(r"EvalPython \[", plan)) == 2  # the other resolves odd references of inline code, a list a page
    page = '<a href="/n">1</a><script>import("/m.js"); import("./o.js?é")</script><a href=" /n ">2</a><script>import("/m.js"); import("/n")</script><a href="#f">3</a><a href="data:x">4</a><script src="/o.wasm"></script><link rel=preload as=script href="m.map">'
    pages = spark.createDataFrame([(1, "https://h.example/p", page), (2, "https://h.example/p", None), (3, None, page[:19])], "k long, url string, html string")
    got = sorted(map(tuple, candidates.html_candidates(pages, "k").collect()))
    assert got == [
        (1, 0, "https://h.example/o.wasm", "script", "html:script"), (1, 1, "https://h.example/m.map", "source-map", "html:preload"), (1, 2, "https://h.example/n", "html", "html:a"),
        (1, 1 << 32, "https://h.example/m.js", "script", "html:inline-script"), (1, (1 << 32) + 1, "https://h.example/o.js?%C3%A9", "script", "html:inline-script"),
    ]


def test_scripts_are_searched_and_resolved_once(spark):
    """No filter below the explode makes the list of references anew, which took minutes for what takes seconds."""
    from sparkloom.operators import candidates

    plan = _plan(spark, "js_candidates").optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if re.match(r"[\s:|+-]*Filter", line)]
    assert not [f for f in filters if "regexp_extract_all" in f or "transform(" in f] and len(re.findall(r"EvalPython \[", plan)) == 1
    rows = [(1, "https://h.example/a", "x"), (2, "https://h.example/a", None), (3, "https://h.example/a", 'import("./b.js"); import("./b.js"); import("/é.png")'), (4, "https://h.example/a", 'import("data:x")'), (5, None, 'import("./b.js"); import("https://o.example/m.wasm")')]
    got = candidates.js_candidates(spark.createDataFrame(rows, "k long, base_url string, content string"), F.lit("x"), "k").select("k", "seq", "url", "type")
    assert sorted(map(tuple, got.collect())) == [(3, 0, "https://h.example/b.js", "script"), (5, 1, "https://o.example/m.wasm", "wasm")]


def test_a_stored_index_uses_whole_texts(spark, tmp_path):
    """More than 4000 tokens of a segment, questions behind their 6000th character, and the whole of what is not wanted back."""
    from oracle import check

    rng = random.Random(4)
    words = " ".join(f"w{rng.randint(0, 300)}" for _ in range(9000))
    unwanted = " ".join(f"q{k}" for k in range(400))[:300]
    texts = ["ab " * 5461, words, words[:1000] + unwanted + " " + words[:16000] + unwanted[:280] + " q " + words[:9000], "", None, "é ſ1 K2 " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, queries.rag_stored, queries.ORACLES["rag_stored"], str(tmp_path))
    got = {tuple(r)[:3]: r.score for r in queries.rag_stored(spark, str(tmp_path)).collect()}
    assert got[0, 0, 0] == 5461**2  # the one segment against its own text
    assert got[2, 1, 1] > 0 and (2, 1, 0) not in got  # the second segment has 280 of the 300 characters
    assert not re.search(r"\[1:\d+\]|6000|256", queries.ORACLES["rag_stored"])


def test_a_question_is_counted_once_for_all_segments(spark):
    from unittest import mock

    import pyarrow as pa

    from sparkloom.operators import retrieval

    times = []
    with mock.patch.object(retrieval, "Counter", lambda x: times.append(1) or Counter(x)):
        batches = [(pa.array(["a1 a1 b2"] * 3), pa.array(["a1", "b2 b2 a1", None])), (pa.array(["a1 a1 b2", None]), pa.array(["zz a1", "a1"]))]
        got = [x.to_pylist() for x in retrieval.shared_weight.func(iter(batches))]
    assert got == [[2, 4, 0], [2, 0]] and len(times) == 2


def test_no_table_of_runs_is_broadcast(spark):
    """A trace's lists are estimated by their compressed file and take thirty times that on the driver."""
    plan = _plan(spark, "runtime_merge").executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

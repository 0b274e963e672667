"""What grows with the data: many matches in a text, long lists, long runs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import flows, ordered
from sparkloom.operators.ordered import Listed


def test_offsets_of_many_matches_in_a_text(spark, tmp_path):
    text = "é".join(f'x("/api/a{i}")' for i in range(20_000))
    at = str(tmp_path / "t")
    spark.createDataFrame([(text,), ("",), ("none",), ('"/api/x"',), (None,)], "t string").coalesce(1).write.parquet(at)
    df, pattern = spark.read.parquet(at), '"/api/[^"]+"'
    got = lambda: {r.t: r.p for r in df.select("t", ordered.match_offsets(F.col("t"), pattern).alias("p")).collect()}
    found = got()
    began = time.time()
    df.select(F.sum(F.size(ordered.match_offsets(F.col("t"), pattern)))).collect()
    assert time.time() - began < 5  # well under one second alone, and some 28 in a fold that copies its list
    for t, places in found.items():
        assert places == (None if t is None else [m.start() for m in re.finditer(pattern, t)])


def test_matches_keep_every_character(spark):
    texts = ['"/api/a\x01b"', '\x01"/api/x"\x01\x01', '"/api/\x01\x01\x02y" \x02 "/api/z"', "\x01\x02\x01", '\x02"/api/q"\x02']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [(r.k, r.pos, r.raw) for r in ordered.matches(df, "t", '"(/api/[^"]+)"', {"raw": 1}, "k").orderBy("k", "pos").collect()]
    assert got == [(k, m.start(), m[1]) for k, t in enumerate(texts) for m in re.finditer('"(/api/[^"]+)"', t)]


def test_one_scan_finds_all_needles(spark):
    rng = random.Random(2)
    pieces = [*flows.NEEDLES, *(n[:-1] for n in flows.NEEDLES), "x", " ", "re", "h", ".", "CAPTCHA", "Sha-", "Too Many"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needles in (flows.NEEDLES, ("a", "ab", "abc", "re", "rec", "x", "too")):
        for r in df.select("t", flows.needles_held(F.col("t"), needles).alias("h")).collect():
            assert set(r.h) == {n for n in needles if n in r.t.lower()}, r.t
    assert df.limit(1).select(flows.needles_held(F.lit(None).cast("string"))).first()[0] is None


def test_capped_lists_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(g, seq, [rng.choice(["a", "b", "c", "d", "", None, "e"]) for _ in range(rng.randint(0, 4))] or None, rng.choice(["x", "y", None])) for g in range(5) for seq in range(30)]
    rows.append((9, 1, None, None))
    df = spark.createDataFrame(rows, "g int, seq long, vs array<string>, one string").repartition(7)
    seq = F.col("seq")
    got = ordered.capped_lists(df, ["g"], {"few": Listed(seq, F.col("vs"), 3), "whole": Listed(seq, F.col("vs"), None), "plain": Listed(seq, F.array("one"), 8, distinct=False)}, F.count("*").alias("n"))
    assert got.columns == ["g", "few", "whole", "plain", "n"]
    for r in got.collect():
        own = sorted((x for x in rows if x[0] == r.g), key=lambda x: x[1])
        flat = list(dict.fromkeys(v for x in own for v in x[2] or [] if v))
        assert (r.few, r.whole, r.plain, r.n) == (flat[:3], flat, [x[3] for x in own if x[3]][:8], len(own))


def test_no_list_is_gathered_before_it_is_cut(spark):
    df = spark.range(1_000_000).selectExpr("id % 2 as g", "id as seq", "array(cast(id as string)) as vs")
    out = ordered.capped_lists(df, ["g"], {"vs": Listed(F.col("seq"), F.col("vs"), 5)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("WindowGroupLimit")  # the plan is read from its end
    assert {r.g: r.vs for r in out.collect()} == {g: [str(g + 2 * k) for k in range(5)] for g in (0, 1)}


@pytest.mark.parametrize("parts", [1, 7, 5000])
def test_running_equals_one_window(spark, tmp_path, parts):
    at = str(tmp_path / "r")
    spark.range(20_000).selectExpr("if(id % 20000 < 15000, 1, null) as run", "id * 3 as seq", "id % 7 = 0 as f", "if(id % 11 = 0, cast(id as string), null) as v").repartition(5).write.parquet(at)
    got = ordered.running(spark.read.parquet(at), ["run"], F.floor(F.col("seq") / (60_000 // parts)), [F.col("seq")], {"before": F.col("f")}, {"last": F.col("v")}, "n")
    assert got.columns == ["run", "seq", "f", "v", "before", "last", "n"]
    counts, lasts, ns = {}, {}, {}
    for r in sorted(got.collect(), key=lambda r: r.seq):
        assert r.before == counts.get(r.run, 0) and r.n == ns.get(r.run, 0) + 1
        counts[r.run], ns[r.run] = counts.get(r.run, 0) + r.f, r.n
        lasts[r.run] = r.v or lasts.get(r.run)
        assert r.last == lasts[r.run]


def test_a_run_is_many_tasks(spark, tmp_path):
    """One run of a million rows: no task holds more than its share."""
    at = str(tmp_path / "m")
    spark.range(1_000_000).selectExpr("1 as run", "id as seq", "id % 3 = 0 as f").repartition(4).write.parquet(at)
    out = ordered.running(spark.read.parquet(at), ["run"], F.floor(F.col("seq") / 4096), [F.col("seq")], {"c": F.col("f")})
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 600_000
    assert out.agg(F.sum((F.col("c") == F.ceil(F.col("seq") / 3)).cast("int"))).first()[0] == 1_000_000

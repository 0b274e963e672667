"""The training-data operators: against SQL, brute force and exact round trips, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA, check
from pyspark.sql import functions as F

from sparkloom.llm import ann, components, decontaminate, html_text, labelled, minhash, mixing, quality, queries, suffix_dedup, texthash, toxicity, url_filter, warc
from sparkloom.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(near), "en", "b", 5), (4, "", "en", "b", 0), (5, None, None, None, None), (None, "one two three", "en", None, 3), (6, "Two words", "en", "a", 9), (7, "two WORDS", "en", "a", 9), (8, words(rng, 60_000), "en", "a", 1), (9, "x" * 200_000, "en", "c", 1), (1, base, "en", "a", 5), (10, "é😀" * 60, "en", "c", 120), (11, " \t\n", "en", "c", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# --- near-duplicates


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    least = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least, sets


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 80)) for k in range(20)]
    for k in range(20, 140):  # a chain of ever more edits, copies and shorter texts
        w = rng.choice(rows)[1].split()
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((k, " ".join(w[: rng.choice((len(w), len(w), len(w) - 3))])))
    least, sets = brute_components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), least[k], least[k] == k) for k, _ in rows}


def test_tables_follow_percent():
    assert minhash.tables(85) == (8, 3)
    for percent in range(50, 101):
        half, rows = minhash.tables(percent)
        s = percent / 100
        assert (1 - (1 - s**rows) ** half) ** 2 >= minhash.RECALL and half <= minhash.MOST_HALF
    with pytest.raises(ValueError):
        minhash.tables(10)


def test_strays_link_at_the_percent_given(spark):
    """Around each base lie documents of about 0.8 to it or to one another: a pivot leaves strays that meet only their own kind."""
    rng, rows = random.Random(80), []
    for base in range(60):
        text = words(rng, 300).split()
        for k in range(8):
            w = list(text)
            for _ in range(rng.randint(1, 6)):  # a changed word takes five shingles of 296
                w[(rng.randrange(280) // 10) * 10 + 5] = words(rng, 1)
            rows.append((base * 8 + k, " ".join(w)))
    sets = {k: shingles(t) for k, t in rows}
    for percent in (75, 80):
        least = {k: k for k in sets}
        links = [(a, b) for a in sets for b in range(a + 1, (a // 8 + 1) * 8) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        for _ in range(8):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=percent).collect()
        assert len(links) > 200 and {r.doc_id: r.component_id for r in got} == least


def test_rare_shingles_find_all_pairs(spark):
    """Every pair of different labels, one of them a stray, that is alike enough, whatever the frequencies."""
    rng = np.random.default_rng(81)
    base = rng.integers(-(2**62), 2**62, 60)
    rows = []
    for k in range(150):
        own = base.copy()
        change = rng.integers(0, 60, rng.integers(0, 16))
        own[change] = rng.integers(0, 40, len(change)) if k % 2 else rng.integers(-(2**62), 2**62, len(change))
        rows.append((k, sorted({int(x) for x in own[: rng.integers(50, 61)]})))
    sets = {k: set(s) for k, s in rows}
    member = [(k, len(s), k % 4, k % 3 == 0) for k, s in rows]
    work = Workspace(spark, "t")
    for percent in (75, 85, 95, 100):
        near = minhash._near(work, spark.createDataFrame(member, "id long, n int, label int, stray boolean"), spark.createDataFrame(rows, "id long, s array<long>"), percent)
        got = {(r.a, r.b) for r in near.collect()}
        want = {(a, b) for a in sets for b in sets if a < b and a % 4 != b % 4 and (a % 3 == 0 or b % 3 == 0) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert want <= got and (len(want) > 10 or percent == 100)


def test_pages_of_one_template_cost_no_pairs(spark):
    """5000 members of one group, 0.75 to 0.84 alike to one another through a template: pairs that meet are few, not 12 million."""
    rng = np.random.default_rng(82)
    template = rng.integers(-(2**62), 2**62, 200).tolist()
    rows = [(k, sorted({*template, *rng.integers(-(2**62), 2**62, int(rng.integers(19, 33))).tolist()})) for k in range(5000)]
    for k in range(0, 5000, 500):  # true copies among them, which are alike through what is their own
        rows[k + 1] = (k + 1, rows[k][1][:-3])
    sets = spark.createDataFrame(rows, "id long, s array<long>")
    member = spark.createDataFrame([(k, len(s), k, True) for k, s in rows], "id long, n int, label int, stray boolean")
    near = {(r.a, r.b) for r in minhash._near(Workspace(spark, "t"), member, sets, 85).collect()}
    assert {(k, k + 1) for k in range(0, 5000, 500)} <= near and len(near) < 5000


@pytest.mark.parametrize("ids", [minhash.BROADCAST_IDS, 0])
def test_near_duplicates_of_repeated_ids_and_both_joins(spark, monkeypatch, ids):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", ids)
    rng = random.Random(83)
    a, b = words(rng, 100), words(rng, 100)
    rows = [(1, a), (2, a + " more"), (3, b), (3, b), (4, words(rng, 50)), (None, a), (None, b), (5, b + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("mine")).withColumn("_gone", F.lit(1))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True), (None, None, True), (None, None, True), (5, 3, False)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "None", "None"]


def test_near_duplicates_on_odd_rows(odd, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert len(got) == odd.count()
    by = {g[0]: g[1:] for g in got}
    assert by[1] == (296, 1, True) and by[2] == (296, 1, False) and by[3] == (296, 1, False)
    assert by[4] == by[4][:1] + (4, True) and by[5][0] == 0 and by[0] == (1, None, True) and by[7] == (1, 6, False)
    assert minhash.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in minhash.keep_one(odd).collect()} == {1, 4, 5, None, 6, 8, 9, 10, 11}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components.components(Workspace(spark, "t"), links).collect()}
    assert got == {**{k: 1 for k in range(2, 31)}, 200: 100, 150: 100} or got == {**{k: 1 for k in range(1, 31)}, 100: 100, 200: 100, 150: 100}


def test_hashes_do_not_depend_on_neighbours():
    a, b = b"one two three four five six", b"seven eight"
    alone, both = texthash.shingle_sets([a])[0], texthash.shingle_sets([b, a])[1]
    assert (alone == both).all() and len(alone) == 2


# --- suffix arrays


def brute_repeats(rows):
    seen, out = set(), {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = True
            seen.add(b[s : s + 100])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
        out[k] = (len(b), int(cover.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


def digest(df):
    found = suffix_dedup.with_spans(df)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("long"))
    sha = F.when(F.col("spans").isNull(), F.sha2("text", 256)).otherwise(suffix_dedup._left_sha256("text", "spans"))
    rows = found.select("row.doc_id", F.octet_length("text"), removed, F.coalesce(F.size("spans"), F.lit(0)), sha).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    passages = [words(rng, n) for n in (14, 17, 18, 20, 40, 90)]
    rows = []
    for k in range(60):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)])
        rows.append((k, " ".join(parts)))
    rows += [(100, "ab" * 400), (101, "z" * 150 + "y" + "z" * 150), (102, rows[5][1]), (103, "é" * 120)]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute_repeats(rows)


def brute_rows(spark, rows):
    """As brute_repeats, for rows that may repeat an id or have none: a Counter of (id, n_bytes, n_removed, n_spans, sha)."""
    order = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("tie")).distinct().collect()
    order = sorted(((2**63 - 1 if r.doc_id is None else r.doc_id, r.tie), r.text) for r in order)
    found = brute_repeats([(k, t) for k, (_, t) in enumerate(order)])
    of = {((key[0] if key[0] < 2**63 - 1 else None), t): found[k] for k, (key, t) in enumerate(order)}
    return Counter((k, *of[k, t]) for k, t in rows)


def digest_rows(df):
    found = suffix_dedup.with_spans(df)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("long"))
    sha = F.when(F.col("spans").isNull(), F.sha2("text", 256)).otherwise(suffix_dedup._left_sha256("text", "spans"))
    return Counter(tuple(r) for r in found.select("row.doc_id", F.octet_length("text"), removed, F.coalesce(F.size("spans"), F.lit(0)), sha).collect())


@pytest.mark.parametrize("ids", [suffix_dedup.BROADCAST_IDS, 0])
def test_unlike_texts_with_one_id_or_none_are_documents_of_their_own(spark, monkeypatch, ids):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", ids)
    rng = random.Random(33)
    p, own = words(rng, 40), [words(rng, 60) for _ in range(8)]
    rows = [(1, f"{own[0]} {p}"), (None, f"{own[1]} {p}"), (None, own[2]), (2, own[3]), (2, f"{p} {own[4]}"), (2, f"{p} {own[4]}"), (3, own[5]), (3, own[5] + own[6]), (None, own[7]), (None, None), (None, own[7])]
    assert digest_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_rows(spark, rows)


@pytest.mark.parametrize("parts", [1, 6])
def test_hot_passages_are_divided(spark, monkeypatch, parts):
    """A passage in every text, at its ends and cut at all places: groups far beyond the limit, in tasks of several groups of texts."""
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 6)
    rng = random.Random(34)
    p = words(rng, 60)
    rows = [(k, words(rng, 130)[: rng.randint(300, 800)] + p[rng.choice((0, 0, rng.randint(0, 200))) : rng.choice((len(p), len(p), rng.randint(201, len(p))))] + words(rng, 3)) for k in range(1200)]
    rng.shuffle(rows)
    assert sum(len(t) for _, t in rows) > 2 * texthash.GROUP_BYTES
    keep, levels = Workspace.keep, []
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name: levels.append(name) or keep(self, df, name))
    assert digest_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == brute_rows(spark, rows)
    assert levels.count("pieces") > 3


def test_a_task_sends_few_rows_of_a_hot_passage():
    rng = random.Random(35)
    p = words(rng, 60).encode()
    own = [(k, 0, 0, words(rng, 60).encode() + p + words(rng, 3).encode()) for k in range(4000)]
    rows = pa.Table.from_batches(list(suffix_dedup._runs_of(own, suffix_dedup._Seen()))).to_pandas()
    rows = rows[rows.kind != suffix_dedup.COPY]
    assert rows[rows.kind == suffix_dedup.NORMAL_RUN].groupby("h").size().max() <= 2 * 5 and (rows.kind == suffix_dedup.DEALT).sum() > 3000
    assert rows.groupby(["h", "run"]).size().max() <= 5 and rows.groupby(["h", "run"]).size().mean() < 1.01


def test_repeats_in_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    rng = random.Random(4)
    p = words(rng, 200)
    text = words(rng, 300) + p + words(rng, 50) + p
    ends = [(a, part) for a, part in suffix_dedup._slices(text.encode())]
    assert b"".join(part[: 500] for _, part in ends[:-1]) + ends[-1][1] == text.encode()
    rows = [(1, text), (2, p)]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_classes_equal_windows():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 3, 3000).astype(np.uint8)
    text[1000:1300] = text[200:500]
    got = suffix_dedup.classes(text, 20)
    keys = [text[k : k + 20].tobytes() for k in range(2980)]
    assert len(set(keys)) == len(set(got[:2980].tolist())) == len(set(zip(keys, got.tolist(), strict=False)))


def test_repeats_on_odd_rows(odd, empty):
    assert suffix_dedup.with_spans(odd).count() == odd.count()
    left = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd).collect()}
    assert left[2].text == "" and left[2].n_chars == 0 and left[1].n_chars == 5 and left[9].text == "x" and left[4].text == ""
    assert suffix_dedup.remove_repeats(odd).columns == odd.columns and suffix_dedup.remove_repeats(empty).count() == 0


# --- decontamination


def test_contamination_on_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "two words"), (2, "Two, Words!"), (3, ""), (None, "x"), (4, None)], "item_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.contamination(odd.withColumn("items", F.lit(1)), bench).collect()}
    assert got[6].items == ["1", "2"] and got[6].n_hit == 2 and got[6].spans == [[0, 9]] and got[5].n_words == 0 and got[8].n_hit == 0
    assert {r.doc_id for r in decontaminate.decontaminate(odd, bench).collect()} == {1, 2, 3, 4, 5, None, 8, 9, 10, 11}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


def plain_contamination(items, text, window=13):
    """(words, hits, items) by comparing all windows at all places."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(window, len(v))
        for a in range(len(v) - n + 1) if v else ():
            for b in range(len(w) - n + 1):
                if v[a : a + n] == w[b : b + n]:
                    hit.update(range(b, b + n))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None) + [None] * (None in found)


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_scanner_against_comparing_all_windows(window):
    rng = random.Random(6)
    for _ in range(60):
        text = lambda n: " ".join(rng.choice(("a", "b", "É", "cc")) + rng.choice(("", "", ".", "-x")) for _ in range(n))
        items = [(rng.choice(("1", "2", "10", None)), text(rng.choice((0, 1, 3, 5, 13, 14, 30)))) for _ in range(rng.randint(0, 6))]
        docs = [text(rng.choice((0, 2, 9, 40))) + " " + " ".join(rng.choice(items)[1].split()[rng.randint(0, 3) :] if items else ["a"]) + " " + text(3) for _ in range(4)]
        scanner = decontaminate.Scanner([(k, t.encode().translate(decontaminate.NORMAL)) for k, t in items], window)
        for doc in docs:
            assert scanner.scan(doc.encode())[:3] == plain_contamination(items, doc, window)


def test_spans_are_code_points_of_the_original():
    scanner = decontaminate.Scanner([("1", b"two words")])
    text = "É 😀 Two,\nWORDS; two words"
    n, hit, _, spans = scanner.scan(text.encode())
    assert (n, hit) == (6, 4) and [text[a:b] for a, b in spans] == ["Two,\nWORDS; two words"]


def test_a_large_benchmark_is_one_automaton():
    """20 MB of items: no rewriting of texts, a node for each word; a phrase that all items share costs no more than its places."""
    rng = np.random.default_rng(60)
    vocabulary = np.array([f"w{k:05d}" for k in range(60_000)])
    items = [(str(k), ("which of these answers is the one that is right " + " ".join(vocabulary[rng.integers(0, 60_000, 40)])).encode()) for k in range(62_000)]
    assert sum(len(t) for _, t in items) > 20_000_000
    scanner = decontaminate.Scanner(items)
    stats = scanner.automaton.get_stats()
    assert stats["nodes_count"] < 2 * 62_000 * 50 and stats["total_size"] < 250_000_000
    doc = b"some text " + items[777][1][40:200] + b" more text which of these answers is the one that is right or so"
    got = scanner.scan(doc)
    assert got[2] == ["777"] and got[1] == len(items[777][1][40:200].split()) - (items[777][1][39:40] != b" ") - (items[777][1][200:201] not in (b" ", b""))


def test_a_benchmark_beyond_its_bound_is_an_error(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="MOST_BYTES"):
        decontaminate.contamination(odd, spark.createDataFrame([(1, "two words and more")], "item_id long, text string"))


def test_items_without_an_id_hit_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma " * 3), (2, "delta"), (3, None), (4, "nothing here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "beta gamma"), (None, "delta"), ("7", "Delta!"), ("8", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check(spark, decontaminate.op9_decontaminate, decontaminate.ORACLE, str(tmp_path))
    got = {r.doc_id: r for r in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert (got[1].n_hit, got[1].n_items, got[2].n_items, got[2].items_sha256) == (6, 1, 2, hashlib.sha256(b"7").hexdigest())


# --- mixing


def fill(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**{s: float(cap * sizes[s]) for s in capped}, **share}
        capped.update(over)


def test_targets_against_the_loop(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 17):
        sizes = {f"s{k}": rng.choice((0, 1, 10, 1000, rng.randrange(10**6))) for k in range(n)} | {None: 50}
        got = mixing.source_targets(Workspace(spark, "t"), spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = fill(sizes)
        assert all(r.target == pytest.approx(want[r.source]) for r in got)


def test_mix_with_many_sources_and_either_join(spark, monkeypatch, odd):
    rng = random.Random(71)
    docs = spark.createDataFrame([(k, words(rng, rng.choice((1, 5, 200))), rng.choice((f"site{rng.randrange(900)}", "hot"))) for k in range(3000)], "doc_id long, text string, source string")
    first = sorted(map(str, mixing.mix(docs).collect()))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(r.text.split())
    want = fill(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == first
    assert mixing.mix(odd).count() == odd.count()


def test_mix_on_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.copies == 0 for r in got if r["size"] == 0) and all(r.copies <= 3 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    copies = Counter((r.doc_id, r.source) for r in mixing.emit(odd.withColumn("copy_no", F.lit(9)).withColumn("size", F.lit("x"))).collect())
    assert copies == Counter({k: n for k, n in Counter({k: 0 for k in ()}).items()}) + Counter(k for r in got for k in [(r.doc_id, r.source)] * r.copies)
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


# --- archives


def test_archive_round_trip(spark):
    big = "é<p>" + "x" * 2000
    rows = [(1, "http://a b/\n", big), (5, None, big), (3, "http://c", big), (4, "u", "small"), (6, "u", "small"), (7, "http://é", None), (8, "v", ""), (None, "w", big), (9, "w", "line\r\n\r\nWARC/1.1\nend"), (9, "w", "line\r\n\r\nWARC/1.1\nend")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).repartition(3)).collect()
    want = Counter((k, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and k in (1, 3) else "response", 5 if h == big and k in (1, 3) else None) for k, _, h in rows if k)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id) == want and len(got) == len(rows)
    assert {r.url for r in got if r.page_id == 1} == {"http://a%20b/%0A"}
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_revisits_name_the_record_they_refer_to(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)  # the other join
    work = Workspace(spark, "t")
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/", big), (5, "http://b /", big), (3, "http://c/", big)], "page_id long, url string, html string").repartition(2)
    index = work.keep(warc.write_arc(pages, f"{work.root}/arc"), "index")
    files = [r.path for r in warc.convert(index, work.keep(warc.keepers(index), "keepers"), f"{work.root}/warc").collect()]
    records = [h for f in files for h, _ in warc.read_warc_records(warc.Source(f))]
    kept = [h for h in records if h["warc-type"] == "response"]
    assert len(kept) == 1 and kept[0]["warc-target-uri"] == "http://b%20/"
    revisits = [h for h in records if h["warc-type"] == "revisit"]
    assert len(revisits) == 2
    for h in revisits:
        assert (h["warc-refers-to"], h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == (kept[0]["warc-record-id"], kept[0]["warc-target-uri"], kept[0]["warc-date"])


def test_arc_versions(tmp_path):
    path = f"file://{tmp_path}/x.arc.gz"
    for version in (1, 2):
        sink = warc.GzipSink(path)
        sink.add(warc.arc_version_block(version, "x"))
        sink.add(*warc.arc_record(version, "http://h/", b"body\nhttp://fake 1 2 3 4\n", 7, date="200102"))
        sink.add(b"http://h/2 0.0.0.0 20010203040506 text/html; charset=x 3\n" if version == 1 else b"http://h/2 0.0.0.0 20010203040506 text/html; charset=x 200 - - 9 f 3\n", b"abc\n")
        sink.close()
        (a, first), (b, second) = warc.read_arc(warc.Source(path, piece=5))
        assert warc.split_http(first)[2] == b"body\nhttp://fake 1 2 3 4\n" and second == b"abc" and b["Content-type"] == "text/html; charset=x"
        head, payload, _ = warc.warc_record(a, first, None)
        assert b"WARC-Date: 2001-02-01T00:00:00Z" in head and payload.startswith(b"body")


def test_broken_archive_is_told(tmp_path):
    path = f"file://{tmp_path}/y.arc.gz"
    sink = warc.GzipSink(path)
    sink.add(b"http://h/ 0.0.0.0 20010203040506 text/html 30\nabc")
    sink.close()
    with pytest.raises(ValueError, match="declared length"):
        list(warc.read_arc(warc.Source(path)))


# --- neighbours


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[100:1100] = x[7]  # a third are copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 32), (5200, [float("nan")] + [1.0] * 31), (5300, [None] + [1.0] * 31), (5400, [1.0]), (5500, [float("inf")] * 32), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("list", F.lit(2))
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 14)) and all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in found)
        hit += len(set(want.tolist()) & {v for _, v, _ in found})
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == [7, *range(101, 110)]
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("id") % 100 == 0).collect()
    assert len(few) == 2 and {r.vec_id for r in few} == {1, 2}


@pytest.mark.parametrize("dim", [64, 128, 384])
def test_exact_copies_are_all_found(dim):
    rng = np.random.default_rng(dim)
    turn = ann.rotation(dim)
    for scale in (1.0, 1e5, 1e-5):
        q = rng.normal(size=(120, dim)) * scale
        rows = np.concatenate([np.repeat(q[:60], rng.integers(11, 40, 60), 0), rng.normal(size=(300, dim)) * scale])
        rng.shuffle(rows)
        for p, at in zip(q, ann.scan(q @ turn, rows @ turn, [np.zeros(0, np.int64)] * len(q), 10), strict=True):
            d = ann.distances(p, rows)
            assert (np.sort(d[at])[:10] == np.sort(d)[:10]).all() and len(at) >= (d == d.min()).sum()


def test_bounds_from_the_nearest_list_lose_nothing():
    rng = np.random.default_rng(88)
    q, rows = rng.normal(size=(50, 64)), rng.normal(size=(3000, 64))
    none = [np.zeros(0, np.int64)] * 50
    true = [np.sort(((rows - p) ** 2).sum(1))[:10] for p in q]
    found = ann.scan(q, rows, none, 10, np.array([t[-1] for t in true]))
    assert sum(len(set(np.sort(((rows[at] - p) ** 2).sum(1))[:10]) & set(t)) for p, at, t in zip(q, found, true, strict=True)) >= 0.98 * 500


@pytest.mark.parametrize("most", [8, ann.LISTS])
def test_lists_grow_with_rows_and_tight_clusters_give_every_query_its_ten(spark, monkeypatch, most):
    """With few centers each is cut again; an outlier beside tight groups of copies probes on until it has ten."""
    monkeypatch.setattr(ann, "LISTS", most)
    rng = np.random.default_rng(89)
    x = np.concatenate([np.repeat(rng.normal(size=(20, 16)), 100, 0) + rng.normal(size=(2000, 16)) * 1e-6, rng.normal(size=(500, 16)) * 50])
    x[7] *= 1e3
    lists = ann.Lists(ann.rotation(16), x, len(x))
    assert lists.count >= 40 and (most > 8 or len(lists.fine) > 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(df, F.col("id") % 20 == 7).collect())
    assert got == Counter({k: 10 for k in range(7, 2500, 20)})


@pytest.mark.parametrize("size", [1e160, 1e-170, 1.0])
def test_neighbours_of_very_large_and_small_vectors(spark, size):
    rng = np.random.default_rng(90)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, (v * size).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("id") % 50 == 0).collect()}
    right = 0
    for q in range(0, 300, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        for r, v in enumerate(np.argsort(d)[:10], 1):
            right += got[q, r][0] == v and got[q, r][1] == pytest.approx(d[v] * size, rel=1e-9)
    assert len(got) == 60 and right >= 54


# --- classifiers


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(9)
    rows = []
    for k in range(900):
        toxic, bad = k % 3 == 0, k % 5 == 0
        w = words(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = "zzgrumpf" + rng.choice(("en", "s", "ed", "ly", "ing", "y"))
        if bad:
            w = [x + rng.choice(("###", "$$$", "&&&")) for x in w]
        rows.append((k, "\n".join(" ".join(w[a : a + 12]) for a in range(0, len(w), 12)), int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_accuracy(taught, score, label):
    got = score(taught.select("doc_id", "text"), taught.select("doc_id", label)).join(taught.select("doc_id", label), "doc_id").collect()
    k, held = (3, 1) if label == "toxic" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == held) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == r[label] for r in test) >= 0.95 * len(test)


def test_unseen_forms_share_subwords(taught):
    rows = [(r.text.encode(), r.toxic) for r in taught.collect()]
    model = toxicity.train(rows)
    rng = random.Random(10)
    plain = words(rng, 50)
    a, b = toxicity.log_odds([plain.encode(), (plain + " zzgrumpfish zzgrumpfo zgrumpf").encode()], *model)
    assert b > a + 1


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_scores_of_odd_rows(odd, empty, taught, score):
    for labels in (taught.select("doc_id", "quality", "toxic"), taught.limit(0).select("doc_id", "quality", "toxic")):
        got = score(odd.withColumn("score", F.lit("x")), labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert score(empty, taught.select("doc_id", "quality", "toxic")).count() == 0


def test_held_rows_teach_nothing(taught):
    labels = taught.select("doc_id", "toxic")
    held = labelled.fold(F.col("doc_id"), 3) == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = taught.select("doc_id", "text")
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, other).collect())


def test_marginals_against_enumeration():
    rng = np.random.default_rng(11)
    unary, pair, at = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, pairs, log_z = quality.marginals(unary, pair, at)
    want, want_z = np.zeros(7), 0.0
    for a, b in zip(at[:-1], at[1:], strict=True):
        z, own = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            p = np.exp(sum((unary[a + k] / 2) * (1 if v else -1) for k, v in enumerate(y)) + sum(pair[u, v] for u, v in zip(y[:-1], y[1:], strict=True)))
            z += p
            own += p * np.array(y)
        want[a:b] = own / z
        want_z += np.log(z)
    assert np.allclose(good, want) and log_z == pytest.approx(want_z) and pairs.sum() == pytest.approx(4)


def plain_marginals(unary, pair):
    """Forward-backward of one chain, line by line: P(good), expected pairs."""
    local = [(np.exp(-u / 2), np.exp(u / 2)) for u in unary]
    jump = np.exp(pair)
    f, b = [np.array(local[0])], [np.ones(2)]
    for a in local[1:]:
        f.append((f[-1] @ jump) * a)
        f[-1] = f[-1] / f[-1].sum()
    for a in reversed(local[1:]):
        b.append(jump @ (a * b[-1]))
        b[-1] = b[-1] / b[-1].sum()
    b.reverse()
    good = [(x * y)[1] / (x * y).sum() for x, y in zip(f, b, strict=True)]
    pairs = np.zeros((2, 2))
    for k in range(1, len(f)):
        joint = f[k - 1][:, None] * jump * (np.array(local[k]) * b[k])[None]
        pairs += joint / joint.sum()
    return np.array(good), pairs


def test_marginals_of_long_chains_against_single_steps():
    rng = np.random.default_rng(12)
    lengths = [1, 63, 64, 65, 2, 64 * 64 + 1, 9000, 1]
    at = np.concatenate(([0], np.cumsum(lengths)))
    unary, pair = rng.normal(size=at[-1]) * 3, np.array([[1.2, -0.7], [-0.4, 0.9]])
    weigh = np.repeat(1 / np.array(lengths), lengths)
    good, pairs, _ = quality.marginals(unary, pair, at, weigh)
    want = [plain_marginals(unary[a:b], pair) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(good, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] / n for w, n in zip(want, lengths, strict=True)))


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(13)
    texts = ["\n".join(words(random.Random(k), 6) + "!" * (k % 4) for _ in range(k % 7 + 1)).encode() for k in range(12)]
    objective = quality.Objective([quality.line_features(texts)], np.array([k % 2 for k in range(12)]))
    theta = rng.normal(size=objective.width + 4) * 0.5
    theta[-4:] = 2.0, -1.0, -1.5, 1.0
    _, slope = objective(theta)
    for k in [*range(0, objective.width, 9), *range(objective.width - 2, objective.width + 4)]:
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert slope[k] == pytest.approx((objective(theta + step)[0] - objective(theta - step)[0]) / 2e-5, abs=1e-7)


def test_many_lines_take_few_steps():
    import time

    rng = np.random.default_rng(14)
    at = np.array([0, 100_000])
    start = time.perf_counter()
    good, _, _ = quality.marginals(rng.normal(size=100_000), np.zeros((2, 2)), at)
    assert time.perf_counter() - start < 2 and len(good) == 100_000


def plain_lines(text):
    """The features of a text's lines, written out for str."""
    out, seen = [], set()
    for line in text.split("\n"):
        raw = line.encode()
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        low = [t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t in tokens]
        solid, n = max(sum(len(t) for t in tokens), 1), max(len(tokens), 1)
        share = lambda chars: sum(b in chars for b in raw) / solid
        plain = b".,;:'\"()-?"
        symbols = bytes(b for b in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if b not in plain)
        again = sum(any(k >= back and low[k] == low[k - back] for back in (1, 2, 3)) for k in range(len(low))) / n
        shares = [share(symbols), share(plain), share(range(65, 91)), share(range(48, 58)), again]
        own = [*shares, *(float(shares[k] > cut) for k in (0, 2, 4) for cut in quality.CUTS)]
        out.append([*own, min(solid / n, 20) / 20, np.log1p(len(raw)) / 10, float(not raw), float(bool(raw) and raw in seen)])
        seen.add(raw)
    zero = [0.0] * len(out[0])
    return np.array([x + (out[k - 1] if k else zero) + (out[k + 1] if k + 1 < len(out) else zero) + [float(k == 0), float(k + 1 == len(out)), 1.0] for k, x in enumerate(out)])


def test_quality_scores_against_plain_python(taught, odd):
    rows = [(r.text.encode(), r.quality) for r in taught.limit(300).collect()]
    weight, pair = quality.train(rows)
    texts = [r.text.decode() if isinstance(r.text, bytes) else r.text or "" for r in taught.limit(60).collect() + odd.collect() if len(r.text or "") < 10_000]
    texts += ["", "\n\n", "a a a\nB!? B!?\n\na a a", "é 12\n" * 90]
    got = quality.scores([t.encode() for t in texts], weight, pair)
    for t, score in zip(texts, got, strict=True):
        good, _ = plain_marginals(plain_lines(t) @ weight, pair)
        size = np.array([len(x.encode()) for x in t.split("\n")]) + 1e-9
        assert score == pytest.approx((good * size).sum() / size.sum(), abs=1e-9)


def test_toxicity_scores_against_plain_python(taught):
    rows = [(r.text.encode(), r.toxic) for r in taught.limit(200).collect()]
    weight, bias = toxicity.train(rows)
    texts = [t.decode() for t, _ in rows[:20]] + ["", "!!", "É zzgrumpf x"]
    base = int(texthash.BASE)

    def bucket(gram):
        return sum(int(texthash.BYTE[b]) * pow(base, k, 2**64) for k, b in enumerate(gram)) % 2**64 >> (64 - toxicity.BITS)

    for t, got in zip(texts, toxicity.log_odds([t.encode() for t in texts], weight, bias), strict=True):
        low = re.sub(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", b" ", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
        grams = [w[k : k + n] for w in (b" " + x + b" " for x in low.split()) for n in toxicity.GRAMS for k in range(len(w) - n + 1)]
        want = sum(float(weight[bucket(g)]) for g in grams) / (len(grams) + toxicity.CALM) + bias
        assert got == pytest.approx(want, abs=1e-6)


def test_texts_without_words_teach_a_bias():
    weight, bias = toxicity.train([(b"", 1), (b"", 1), (b"!", 0)])
    assert np.isfinite(weight).all() and np.isfinite(bias)


def test_samples_are_bounded_in_bytes_by_whole_texts(spark):
    docs = spark.createDataFrame([(k, "x" * (1000 if k % 3 else 10_000)) for k in range(90)] + [(1, "x" * 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, toxic int")
    take = lambda **how: labelled.sample(docs, labels, "toxic", F.lit(True), **how)
    assert len(take()) == 90 and len(take(rows=7)) == 7
    few = take(limit=50_000)
    assert sum(len(t) for t, _ in few) <= 50_000 and {len(t) for t, _ in few} <= {1000, 10_000} and sum(len(t) for t, _ in few) > 40_000 and few == take(limit=50_000)


# --- HTML and URLs


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<nav>menu</nav>", ""),
        ("<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><article><header><h1>Big  title</h1></header><p>One&nbsp;two <b>thr</b>ee.<p>Four<br>five<script>var a='</p>'</script></p><aside>Ad</aside><section class='comments'><p>Nice!</p></section><form>mail</form></article><footer>&copy; me</footer>", "Big title One two three. Four five"),
        ("<div class=ad>Buy now, a long advert text that goes on</div><div id=main><p>Some text of the page that is long enough to count.</p><p>And more.</p></div><div class=sidebar><ul><li>x</li></ul></div>", "Some text of the page that is long enough to count. And more."),
        ("<article><p>a<div>b</div>c</p></article>", "a b c"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


LONG = "a sentence of the page that is long enough to be its content " * 4


@pytest.mark.parametrize("inner", ["<article>", "<main>", "<div role=main>", "<div role=article>"])
def test_main_text_keeps_what_is_around_a_nested_article(inner):
    end = "</" + inner[1:-1].split()[0] + ">"
    html = f"<body><nav>Menu</nav><article><p>first {LONG}</p>{inner}<p>second {LONG}</p><p>third {LONG}</p>{end}</article><footer>Foot</footer></body>"
    assert html_text.main_text(html) == " ".join(f"{k} {LONG}".strip() for k in ("first", "second", "third"))


def test_main_text_keeps_sibling_articles_and_main():
    html = f"<body><article><p>first {LONG}</p></article><p>x</p><article><p>second {LONG}</p><p>third {LONG}</p></article></body>"
    assert html_text.main_text(html) == " ".join(f"{k} {LONG}".strip() for k in ("first", "second", "third"))
    html = f"<body><main><p>first {LONG}</p><article><p>second {LONG}</p><p>third {LONG}</p></article></main></body>"
    assert html_text.main_text(html) == " ".join(f"{k} {LONG}".strip() for k in ("first", "second", "third"))


def test_main_text_keeps_formulas():
    html = f"<article><p>{LONG}so <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>a=1</annotation></semantics></math> holds</p></article>"
    assert html_text.main_text(html) == f"{LONG}so a=1 holds"


def plain_main_text(page):
    """Ratio clusters of a well-formed page of p, li, div, article and nav, in plain loops."""
    lines, stack, text, links, tags = [], [], "", 0, 0

    def end():
        nonlocal text, links, tags
        w = text.split()
        if w:
            aside = any(t == "nav" or "comments" in c for t, c in stack)
            lines.append([" ".join(w), tags, links / len("".join(w)), aside, any("related" in c for _, c in stack)])
            tags = 0
        text, links = "", 0

    order, number, opened = [], {}, 0  # of each line the articles around it; the numbers of the open elements
    for token in re.findall(r"<[^>]*>|[^<]+", page):
        if not token.startswith("<"):
            text += token
            links += len("".join(token.split())) if any(t == "a" for t, _ in stack) else 0
            continue
        tags += 1
        name = re.match(r"</?(\w+)", token)[1]
        if name not in ("a", "b"):
            n = len(lines)
            end()
            order += [tuple(number[k] for k in range(len(stack)) if stack[k][0] == "article")] * (len(lines) - n)
        if token.startswith("</"):
            number.pop(len(stack) - 1)
            stack.pop()
        else:
            opened += 1
            number[len(stack)] = opened
            stack.append((name, token))
    ratio = [len(x[0]) / max(x[1], 1) for x in lines]
    weights = [float(np.exp(-0.5 * d * d)) for d in range(-3, 4)]
    smooth = [sum(w * ratio[min(max(k + d, 0), len(ratio) - 1)] for d, w in zip(range(-3, 4), weights, strict=True)) / sum(weights) for k in range(len(ratio))]
    mean = sum(smooth) / len(smooth)
    limit = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
    high = [x >= limit for x in smooth]
    menu = [False] * len(lines)
    for a in range(len(lines)):
        b = a
        while b < len(lines) and not high[b] and lines[b][2] > 0.5:
            b += 1
        if b - a >= 3:
            menu[a:b] = [True] * (b - a)
    good = [not x[3] and not m and (h or not x[4]) for x, m, h in zip(lines, menu, high, strict=True)]
    regions = {order[k][0] for k in range(len(lines)) if good[k] and high[k] and order[k]} or {order[k][0] for k in range(len(lines)) if good[k] and order[k]}
    return " ".join(x[0] for k, x in enumerate(lines) if good[k] and order[k] and order[k][0] in regions), sum(menu), sum(x[4] and not h for x, h in zip(lines, high, strict=True))


def test_ratios_decide_lines_against_a_plain_version():
    rng, menus, soft = random.Random(40), 0, 0

    def block():
        n = rng.choice((1, 2, 3, 30, 60))
        t = words(rng, n)
        kind = rng.randrange(7)
        if kind == 0:
            return "<div>" + "".join(f"<li><a href=x>{words(rng, rng.randint(1, 2))}</a></li>" for _ in range(rng.randint(1, 6))) + "</div>"
        if kind == 1:
            return f"<div class='box related'><p>{t}</p></div>"
        if kind == 2:
            return f"<div class='comments'><p>{t}</p></div>"
        return rng.choice((f"<p>{t}</p>", f"<p><b>{t}</b> {words(rng, 2)}</p>", f"<p><a href=y>{t}</a></p>"))

    for _ in range(300):
        page = "<nav><li><a href=/>home</a></li><li>x</li></nav>" + "".join(f"<article><p>{words(rng, 9)}</p>{''.join(block() for _ in range(rng.randint(1, 9)))}</article>" for _ in range(rng.randint(1, 3))) + f"<div><p>{words(rng, 3)}</p></div>"
        want, a, b = plain_main_text(page)
        assert html_text.main_text(page) == want
        menus, soft = menus + a, soft + b
    assert menus > 50 and soft > 50


def test_a_body_paragraph_stays_whatever_its_soft_name_and_link_lists_go():
    links = "".join(f"<li><a href=/{k}>go {k}</a></li>" for k in range(9))
    html = f"<article><p>{LONG}</p><p>{LONG}</p><div class=related><p>{LONG}</p></div><p>{LONG}</p><ul>{links}</ul></article>"
    assert html_text.main_text(html) == " ".join([LONG.strip()] * 4)


@pytest.mark.parametrize("page", ["<b>x" * 120_000 + "</i>" * 120_000, "<table>" + "<b>" * 150_000 + "<td>x</td>" * 50_000, "<!--" * 250_000, "<a" * 500_000, "<i><table>" + "<b>" * 150_000 + "</i>" * 100_000], ids=range(5))
def test_long_broken_pages_take_linear_time(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 5


def test_extract_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "u", "<article><p>" + "word " * 300_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id, r.text[:5], r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(1, "", 0), (2, "x", 1), (2, "x", 1), (3, "word ", 1_499_999)] and html_text.extract(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [("http://WWW.Shop.example.com/en/1?q=1", "block", "com/en/"), ("https://m.example.com/en/7x", "allow", "example.com/en/7"), ("http://example.net/de/8", "block", "example.net/de/8"), ("http://a.net/de/", "allow", "net/de/"), ("ftp://b.org/es/#x", "block", "org/es/"), ("http://notnet/de/", None, None), ("net/de/1", None, None), (None, None, None), ("http://a.com/EN/1", None, None), ("x://", None, None)]
    df = spark.createDataFrame([(u, v, r) for u, v, r in rows], "url string, want string, want_rule string").withColumn("score", F.lit("mine"))
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows) and all(r.rule == r.want_rule and r.verdict == (r.want or r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert {r.url: (r.host, r.path) for r in got}["http://WWW.Shop.example.com/en/1?q=1"] == ("www.shop.example.com", "/en/1")
    assert url_filter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("grams", [url_filter.BROADCAST_GRAMS, 0])
def test_url_columns_of_other_names_pass_and_both_joins_agree(spark, monkeypatch, grams):
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", grams)
    names = ["text", "decided", "row", "gram", "n", "held", "total", "length", "Score"]
    df = spark.createDataFrame([(k, f"http://h{k % 7}.{'net/de' if k % 2 else 'org/es'}/{k}") for k in range(60)] + [(60, "http://x.fr/de/1"), (61, None)], "page_id long, url string")
    plain = {r.page_id: tuple(r[c] for c in ("host", "path", "rule", "verdict", "score")) for r in url_filter.judge(df).collect()}
    got = url_filter.judge(df.select("*", *(F.lit(f"mine {c}").alias(c) for c in names[:-1])))
    assert got.columns == ["page_id", "url", *names[:-1], "host", "path", "rule", "verdict", "score"]
    for r in got.collect():
        assert tuple(r[c] for c in ("host", "path", "rule", "verdict", "score")) == plain[r.page_id] and all(r[c] == f"mine {c}" for c in names[:-1])
    assert len({v[4] for v in plain.values()}) > 20


def test_columns_of_clashing_names_pass_through_all_operators(odd, spark, taught):
    names = ["id", "tie", "row", "spans", "meta", "key", "contamination", "_contamination", "_shard0", "copies", "rate", "of", "size", "source_size", "target", "_y", "_z", "h", "k", "t", "label", "n", "s"]
    docs = odd.select("*", *(F.lit(f"mine {c}").alias(c) for c in names))
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    labels = taught.select("doc_id", "quality", "toxic")
    for out in (suffix_dedup.remove_repeats(docs), decontaminate.decontaminate(docs, bench), minhash.keep_one(docs), quality.keep_good(docs, labels)):
        assert out.columns == docs.columns and all(r[c] == f"mine {c}" for r in out.collect() for c in names)
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "copy_no"] and all(r[c] == f"mine {c}" for r in out.collect() for c in names)
    out = decontaminate.contamination(docs, bench, name="found")
    assert out.columns == [*docs.columns, "found"] and all(r[c] == f"mine {c}" for r in out.collect() for c in names)


def test_url_scores_against_python(spark):
    """The smoothed model, written out plainly."""
    rng = random.Random(12)
    urls = [f"http://{'good' if k % 2 else 'evil'}{rng.randrange(30)}.net/{'de' if k % 2 else 'es'}/{rng.randrange(99)}" for k in range(120)] + [f"http://new{k}.net/{x}/1" for k, x in enumerate(("de", "es", "fr"))]
    rules = (("allow", "net/de/"), ("block", "net/es/"))
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.score for r in url_filter.judge(df, rules=rules).collect()}
    texts = {u: u.partition("://")[2] for u in urls}
    held = {r.t for r in spark.createDataFrame([(t,) for t in set(texts.values())], "t string").where(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % 5 == 0).collect()}
    n = url_filter.ORDER
    count = {"allow": Counter(), "block": Counter()}
    split = lambda t: [("\2" * n + t + "\3")[k : k + n + 1] for k in range(len(t) + 1)]
    for t in map(texts.get, urls):
        verdict = "allow" if "/de/" in t else "block" if "/es/" in t else None
        if verdict and t not in held:
            for g in split(t):
                for k in range(1, n + 2):
                    count[verdict][g[-k:]] += 1
                    count[verdict][("context", g[-k:-1], k)] += 1

    def p(c, g):
        q = 1 / url_filter.ALPHABET
        for k in range(1, n + 2):
            q = (c[g[-k:]] + url_filter.PRIOR * q) / (c[("context", g[-k:-1], k)] + url_filter.PRIOR)
        return q

    for u, t in texts.items():
        total = sum(round((np.log(p(count["allow"], g)) - np.log(p(count["block"], g))) * 1e6) for g in split(t))
        assert abs(got[u] - total / (len(t) + 1)) <= 2

"""Spelling variants, centroid clustering and packing: against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import packing, spelling, yinyang
from sparkloom.llm.common import Workspace

DOCS = "doc_id long, text string, word string, key long, N long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    rows = [(1, prose, "x", 1, 1), (1, prose, "x", 1, 1), (2, "", None, 2, 2), (3, None, None, None, None), (None, "another words Wörds wordsx", "y", 3, 3), (4, "x" * 30_000, "z", 4, 4), (5, "a  b\n c \t d <|endoftext|> e", None, 0, 0), (6, "😀 " * 5000, None, 0, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    return a != b and any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        mates = [x for x in counts if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(mates, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, n, len(mates), counts[best] if best and counts[best] >= 2 * n else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, form, root(w), n, k, form_n) for w, (form, n, k, form_n) in out.items()}


@pytest.mark.parametrize("alphabet,longest,most", [("ab", 9, 4), ("abé", 8, 2000), ("abcdefgh", 12, 20), ("xy", 14, 30)])
def test_spelling_equals_all_pairs(spark, alphabet, longest, most):
    rng = random.Random(len(alphabet) * longest)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, longest))): rng.choice([3, 4, 6, 9, 20, 50, 400]) for _ in range(350)}
    for w in list(counts)[:100]:  # near ones of all kinds
        k = rng.randrange(len(w))
        counts.setdefault(w[:k] + rng.choice(alphabet) + w[k:], 3)
        counts.setdefault(w[:k] + "q" + w[k + 1 :], 7)
        if len(w) > 5:
            counts.setdefault(w[:k] + w[k + 1 :], 90)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most)
    assert {tuple(r) for r in got.collect()} == plain_variants(counts)


def test_spelling_divides_pieces_whatever_they_share(spark):
    """All words share all but a few characters; no piece holds more than it may and no pair is lost."""
    rng = random.Random(8)
    counts = {"zqzqzq" + "".join(rng.choice("abc") for _ in range(5)) + "qzqz": 3 + k % 5 for k in range(400)}
    work = Workspace(spark, "t")
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_pairs(work, words, 8).collect()}
    want = {(a, b) for a in counts for b in counts if a < b and near(a, b)}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_long_words_compare_in_full(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd") for _ in range(5000))
    others = [base[:k] + "é" + base[k + d :] for k, d in ((0, 0), (2500, 1), (5000, 0), (4999, 1))]
    words = spark.createDataFrame([(w, 3) for w in [base, *others]], "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_pairs(Workspace(spark, "t"), words).collect()}
    assert {b if a == base else a for a, b in got if base in (a, b)} == set(others)


def test_runs_spoil_by_checksum():
    text = "Hello hello WORLD ÄÖ plain words " * 3
    got = Counter()
    for w, n in spelling.runs(12, text, 1, 3):
        got[w] += n
    want = Counter()
    for raw in text.split():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        h = zlib.crc32(f"12:{low}".encode())
        want[low if h % 3 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    want.pop("", None)
    assert got == want


def test_spelling_odd_rows(spark, odd, empty):
    rows = {r.word: r for r in spelling.variants(spelling.count_words(odd, least_count=1)).collect()}
    assert rows["another"].n == 1 and rows["words"].n_near == 2 and rows["x" * 30_000].n == 1 and rows["wörds"].form is None
    assert spelling.variants(spelling.count_words(empty)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(70)] + [("v", "w000"), ("u", "v")]
    got = {r.word: r.root for r in spelling.roots(Workspace(spark, "t"), spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w070"} and len(got) == 72


# --- clustering


def plain_clusters(vectors, k, rounds, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cents = [[sum(c) // len(c) for c in zip(*members, strict=True)] if (members := [v for (_, v), j in zip(kept, of, strict=True) if j == m]) else old for m, old in enumerate(cents)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


@pytest.mark.parametrize("n,dim,k,groups", [(300, 4, 12, None), (200, 3, 7, 1), (150, 2, 20, 9), (5, 3, 8, None)])
def test_clusters_equal_plain_rounds(spark, n, dim, k, groups):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, dim)) * 0.01, 3)  # many ties
    x[: n // 4] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    got = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=k, dim=dim, groups=groups)
    want, cents = plain_clusters(rows, k, 10)
    assert sorted(map(tuple, got.assigned.collect())) == sorted(want) and got.centroids == cents
    assert sum(got.inertias) == sum(d for _, _, d in want)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(32, 8)) * 5
    rows = [(int(i), [float(v) for v in heads[i % 32] + rng.normal(size=8) * 0.05]) for i in range(3200)]
    got = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=32, dim=8)
    assert got.measured < 0.5 * 3200 * 32 * got.passes


def test_rounds_join_without_exchange(spark):
    work = Workspace(spark, "t")
    buckets = yinyang._Buckets(work, 4)
    one = buckets.write(spark.range(100).selectExpr("id as rid", "id as v").repartition(4, "rid"), "one")
    two = buckets.write(spark.range(100).selectExpr("id as rid", "id as w").repartition(4, "rid"), "two")
    plan = spark.table(one).join(spark.table(two).hint("shuffle_hash"), "rid")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    buckets.drop(one)
    buckets.drop(two)


def test_vectors_that_take_no_part(spark):
    good = [0.5, -0.25]
    rows = [(1, good, "a"), (2, None, "b"), (3, [0.5], "c"), (4, [0.5, None], "d"), (5, [float("nan"), 1.0], "e"), (6, [float("inf"), 1.0], "f"), (7, [1.0, 2.0, 3.0], "g"), (8, [], "h"), (None, good, "i"), (1, good, "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rid string").withColumn("cluster", F.lit(1)).withColumn("v", F.lit(None).cast("string"))
    got = yinyang.cluster(df, k=2, dim=2)
    assert sorted(got.assigned.collect(), key=str) == sorted([(1, 0, 0), (1, 0, 0), (None, 0, 0)], key=str)
    none = yinyang.cluster(df.where("vec_id = 2"), k=2, dim=2)
    assert none.assigned.columns == ["vec_id", "cluster", "distance"] and none.assigned.count() == 0 and none.centroids == []


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="in magnitude"):
        yinyang.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dim=1)


def test_scales_are_floors(spark):
    rows, x = yinyang.scaled(spark.createDataFrame([(1, [-0.0001, 0.00098, 1.0])], "a long, b array<double>").toArrow()["b"], 3, 1024)
    assert x.tolist() == [[-1, 1, 1024]] and rows.tolist() == [0]


# --- packing


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([4, 17, 64, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 150))]
    rules, made = packing.plan(Counter(lengths), size)
    fill, ranks, places = Counter(), Counter(), {}
    for n, first, last, per, sequence, place in rules:
        for rank in range(first, last):
            at, offset = sequence + (rank - first) // per, place + (rank - first) % per * n
            assert offset == places.get(at, 0)  # rules fill a sequence in their order, without gaps
            places[at] = offset + n
            fill[at] += n
            ranks[n] += 1
    assert ranks == Counter(lengths) and made == len(fill) and sorted(size - f for f in fill.values()) == best_fit(lengths, size)


def test_plan_is_short_whatever_the_input():
    rules, made = packing.plan({n: 10**12 // n for n in range(1, 1025)})
    assert len(rules) < 5000 and made * 1024 >= sum(n * (10**12 // n) for n in range(1, 1025))


def plain_pieces(texts, size):
    tok = packing.Tokens(packing.public_tokenizer()).tokenizer
    out = []
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        out += [(doc, n, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out


def test_pack_places_all_pieces(spark, odd):
    got = packing.pack(odd, size=64, with_ids=True)
    rows = got.collect()
    want = plain_pieces([(r.doc_id, r.text) for r in odd.collect()], 64)
    assert sorted([tuple(r[:5]) for r in rows], key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == len(best_fit([r.length for r in rows], 64))
    made = {r.sequence_id: r for r in packing.sequences(got).collect()}
    for k, held in by.items():
        assert len(made[k].ids) == 4 * sum(n for _, n in held)


def test_pack_of_nothing(spark, empty):
    assert packing.pack(empty).count() == 0


def test_words_give_the_ids_of_whole_texts(spark, monkeypatch):
    rng = random.Random(9)
    signs = ["a", "b", "é", "ß", "Wort", "don't", "'s", "1", "²", "３", ".", ",", "!?", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "<|endoftext|>", "😀", "漢字", "_", "'"]
    monkeypatch.setattr(packing, "MEMORY", 50)  # words are forgotten and met again
    monkeypatch.setattr(packing, "CHUNK", 40)
    tokens = packing.Tokens(packing.public_tokenizer())
    own, texts = [], []
    for _ in range(600):
        text = "".join(rng.choice(signs) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 60)))
        want = array("I", tokens.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        assert tokens(text) == want, repr(text)
        own.append(want)
        texts.append(text)
    monkeypatch.setattr(packing, "GROUP", 400)
    assert list(tokens.all(pa.array([*texts, None]))) == [*own, b""]


def test_ranks_run_on_over_tasks(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same text' as text").repartition(7)
    got = packing.pack(docs, size=10)
    assert got.select("sequence_id", "offset").distinct().count() == 3000 and got.agg(F.countDistinct("sequence_id")).first()[0] == 1000

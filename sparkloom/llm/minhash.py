"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of ``half`` keys, each of ``rows`` minhashes, give half * half table keys by
pairing. A link of similarity s is a candidate with probability (1 - (1 - s ** rows) ** half) ** 2. Both numbers
come from the least similarity that links (``tables``), so that such a link is a candidate with ``RECALL`` at least: at
0.85 48 minhashes make 64 tables of 6, at 0.8 66 make 121.

Documents with equal shingle sets become one representative first, so copies cost one row. Buckets are never
expanded into all pairs. Each has a pivot, the member whose buckets are fullest, and all members meet it; confirmed
links are contracted. Bucket mates share a pivot, so what is left to compare are, for each pivot, strays, which are
members still apart from it, with members of other components (``_near``). Of these, pairs meet only by their rarest
shingles: sets of n shingles that are alike enough share one of their n - ceil(n * percent / 100) + 1 rarest, and it
stands early enough in both. That drops no link. Pages of one template, alike in part, have the rest of their own as their
rarest shingles, which nobody shares, so a group of any number of them costs no pairs. Pairs that meet are confirmed
on full sets.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer than
five words the whole sequence is the one shingle; rows with a null id are not linked (component null, kept);
rows that repeat an id with unlike texts are documents of their own, linked by their own sets, and a component is known by the least id
in it; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import Workspace, table
from sparkloom.llm.components import components
from sparkloom.llm.texthash import PLACE, U, mix, shingle_sets, text_groups

SHINGLE = 5
PERCENT = 85
#: What a link of least similarity is a candidate with, and bounds of the keys in a half and of the minhashes in a key.
RECALL = 0.999
MOST_HALF, MOST_ROWS = 12, 3
BROADCAST_IDS = 1_000_000
_A = np.random.default_rng(85).integers(1, 2**63, (2 * MOST_HALF * MOST_ROWS, 2), dtype=np.uint64) * U(2) + U(1)
DIGEST = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n", "h1", "h2")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("left", "right"))])


def tables(percent: int) -> tuple[int, int]:
    """(half, rows): the fewest keys of most minhashes that reach RECALL at percent."""
    for rows in range(MOST_ROWS, 0, -1):
        for half in range(1, MOST_HALF + 1):
            if (1 - (1 - (percent / 100) ** rows) ** half) ** 2 >= RECALL:
                return half, rows
    raise ValueError(f"no {MOST_HALF} keys reach a recall of {RECALL} at {percent} percent")


def signatures(sets: list[np.ndarray], half: int, rows: int) -> np.ndarray:
    """2 * half keys for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.zeros((len(sets), 2 * half), np.uint64)
    for i, (a, b) in enumerate(_A[: 2 * half * rows]):
        least = np.minimum.reduceat((flat ^ b) * a, at)
        keys[:, i // rows] += mix(least) * PLACE[i % rows]
    return mix(keys + np.arange(2 * half, dtype=np.uint64))


def _digests(texts: pa.Array, half: int, rows: int) -> pa.Array:
    n, h1, h2 = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    keys = np.zeros((len(texts), 2 * half), np.uint64)
    for a, b, raw in text_groups(texts):
        sets = shingle_sets(raw, SHINGLE)
        n[a:b] = [len(s) for s in sets]
        if full := [k for k, s in enumerate(sets) if len(s)]:
            chosen = [sets[k] for k in full]
            keys[np.array(full) + a] = signatures(chosen, half, rows)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in chosen])[:-1]))
            flat = np.concatenate(chosen)
            h1[np.array(full) + a] = np.add.reduceat(mix(flat + U(1)), starts)
            h2[np.array(full) + a] = np.add.reduceat(mix(flat ^ U(0x5DEECE66D)), starts)
    lists = lambda part: pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * half), pa.array(np.ascontiguousarray(part).reshape(-1).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists(keys[:, :half]), lists(keys[:, half:])], names=["n", "h1", "h2", "left", "right"])


def _digest_udf(half: int, rows: int):
    @F.arrow_udf(DIGEST)
    def digest(texts: pa.Array) -> pa.Array:
        return _digests(texts, half, rows)

    return digest


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pa.Array) -> pa.Array:
    sets = [s for _, _, raw in text_groups(texts) for s in shingle_sets(raw, SHINGLE)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough. A set meets its pairs by a join, so a pivot's many pairs can be split."""
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def _up(x: Column, by: int = 100) -> Column:
    """ceil(x / by) of whole numbers."""
    return F.floor((x + (by - 1)) / by).cast("int")


def _near(work: Workspace, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels, one a stray, that may be alike: all that are and share a pivot are among them.

    member: id, n, label, stray, a row for each document that shares a pivot with a stray; sets: (id, s).
    """
    tokens = work.keep(sets.join(member, "id").select("id", "n", "label", "stray", F.explode("s").alias("t")), "tokens")
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # what is no one else's is not looked up, but counts as rarest; it is known by its number
    shared = tokens.join(often, "t").groupBy("id", "n", "label", "stray").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("r"))
    first = F.col("n") - _up(F.col("n") * percent) + 1 - (F.col("n") - F.size("r"))  # so many of the shared ones
    rare = shared.select("id", "n", "label", "stray", (F.col("n") - F.size("r")).alias("own"), F.posexplode(F.slice("r", 1, F.greatest(first, F.lit(0)))).alias("k", "r"))
    rare = work.keep(rare.select("id", "n", "label", "stray", (F.col("own") + F.col("k")).alias("k"), F.col("r.t").alias("t")), "rare")
    work.drop(tokens)
    mate = rare.select("t", *(F.col(c).alias(f"{c}_m") for c in ("id", "n", "label", "stray", "k")))
    need = _up((F.col("n") + F.col("n_m")) * percent, 100 + percent)  # shingles that two alike sets share
    left = F.least(F.col("n") - F.col("k"), F.col("n_m") - F.col("k_m"))  # what they can share from here on
    once = ~F.col("stray_m") | (F.col("id") < F.col("id_m"))  # two strays meet once
    met = rare.where("stray").join(mate, "t").where((F.col("label") != F.col("label_m")) & once & (left >= need))
    return met.select(F.least("id", "id_m").alias("a"), F.greatest("id", "id_m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept. percent: the least similarity that links."""
    work = Workspace(docs.sparkSession, "minhash")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    digest = work.keep(source.select("doc_id", "tie", _digest_udf(*tables(percent))("text").alias("d")).select("doc_id", "tie", "d.*"), "digests")
    same = ["n", "h1", "h2"]
    full = digest.where("n > 0 and doc_id is not null")
    # a set is known by a number of its own, as an id may come with several texts; a text is found by its id and hash
    reps = full.groupBy(*same).agg(F.min_by(F.struct("doc_id", "tie", "left", "right"), F.struct("doc_id", "tie")).alias("r")).select(*same, "r.*")
    reps = work.keep(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    keys = reps.select("id", "n", F.explode("left").alias("l"), "right").select("id", "n", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id", "n")
    hot = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = work.keep(keys.join(hot, "key"), "live")

    ids = work.keep(reps.select("id", "doc_id", "tie").join(live.select("id").distinct(), "id"), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = source.join(wanted, ["doc_id", "tie"])
    sets = work.keep(texts.select("id", _shingles("text").alias("s")), "sets")
    if sets.count() > ids.count():  # rows that repeat an id and a text
        sets = work.keep(sets.groupBy("id").agg(F.min("s").alias("s")), "sets-once")

    fame = live.groupBy("id").agg(F.sum("c").alias("fame"))
    famed = work.keep(live.join(fame, "id"), "famed")
    work.drop(live)
    live = famed
    pivots = live.groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("fame", -F.col("id"))).alias("p")).select("key", "p.*")
    stars = live.join(pivots.select("key", F.col("id").alias("p"), F.col("n").alias("pn")), "key").select("p", "pn", "id", "n").distinct()
    stars = work.keep(stars, "stars")
    work.drop(live)
    apart = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
    links = work.keep(_confirmed(stars.where((F.col("p") != F.col("id")) & apart).select(F.col("p").alias("b"), F.col("id").alias("a")), sets, percent), "links")
    labels = components(work, links)

    named = labels.withColumnRenamed("node", "id")
    member = stars.join(named, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    member = member.join(named.select(F.col("id").alias("p"), F.col("component").alias("home")), "p", "left")
    member = work.keep(member.select("p", "id", "label", (F.col("label") != F.coalesce("home", "p")).alias("stray")), "members")
    open_ = member.where("stray").select("p").distinct()
    member = member.join(open_, "p", "left_semi").groupBy("id").agg(F.first("label").alias("label"), F.max("stray").alias("stray"))
    sized = sets.select("id", F.size("s").alias("n"))
    member = work.keep(member.join(sized, "id"), "mates")
    if not member.isEmpty():
        more = work.keep(_confirmed(_near(work, member, sets, percent), sets, percent), "more")
        if not more.isEmpty():
            labels = components(work, links.union(more))

    # components are named by the least id in them
    of = labels.union(labels.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "id")
    least = of.join(reps.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    classes = reps.select(*same, "id", "doc_id").join(of.join(least, "component").select("id", "least"), "id", "left")
    classes = work.keep(classes.select(*same, F.coalesce("least", "doc_id").alias("component_id")), "classes")
    out = digest.select("doc_id", *same).join(classes, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without those that have a near copy of a smaller id."""
    out = near_duplicates(docs, id_col, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Workspace(docs.sparkSession, "minhash").keep(out, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

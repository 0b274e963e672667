"""Rows that repeat an id, with the same text or another."""

import random

from sparkloom.llm import minhash, suffix_dedup
from sparkloom.llm.common import Workspace
from pyspark.sql import functions as F


def prose(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_unlike_texts_of_one_id_keep_all_their_links(spark):
    a, b = prose(1), prose(2)
    near = lambda w: " ".join([*w[:-2], "changed", "too"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (3, near(b)), (2, near(b)), (4, " ".join(prose(3))), (4, " ".join(prose(4))), (2, near(a))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, 196, 1, True), (2, 196, 1, False), (2, 196, 1, False), (2, 196, 2, True), (2, 196, 2, True), (3, 196, 2, False), (4, 196, 4, True), (4, 196, 4, True)])


def test_a_row_repeated_many_times_costs_its_pieces_once_a_task(spark):
    text = " ".join(prose(5, 60))
    base = spark.createDataFrame([(7, text), (8, " ".join([*prose(6, 40), *prose(5, 60)[:40]]))], "id long, text string")
    docs = base.where("id = 8").unionByName(spark.range(100_000).selectExpr("7 as id").join(F.broadcast(base), "id")).repartition(4)
    docs = docs.select("id", F.xxhash64(F.col("text").cast("binary")).alias("tie"), F.col("text").cast("binary").alias("text"))
    docs = Workspace(spark, "t").keep(docs, "docs")
    runs = docs.mapInArrow(suffix_dedup._anchor_rows, suffix_dedup.RUNS)
    per_text = runs.groupBy("id").count().collect()
    assert all(r["count"] < 4 * len(text) for r in per_text)
    metas = docs.withColumn("metas", F.array(F.lit((100 << 16) | (50 << 8) | 20).cast("long")))
    assert metas.mapInArrow(suffix_dedup._cut_runs, suffix_dedup.PIECES).count() <= 2 * 2 * 4
    found = {r.id: r.spans for r in suffix_dedup.repeated_spans(Workspace(spark, "t"), docs).collect()}
    once = {r.id: r.spans for r in suffix_dedup.repeated_spans(Workspace(spark, "t"), docs.dropDuplicates(["id", "tie"])).collect()}
    assert found == once and set(found) == {8}

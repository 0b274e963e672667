"""Mixing sources to target weights.

Tokens are summed per source. Sources are ranked in parallel and targets found in rounds, each one sum over the sources, so
there may be as many as there are domains. The repetition rate of a source is its target over its size, and each
document is taken floor(rate) times plus one more time if a hash of its id, uniform in [0, 1), lies below the
rate's fraction. A rerun draws the same copies, whatever the partitions.

Defined cases: null text and text without words have size 0 and are taken 0 times; a null source is a
source of its own, last in order; repeated rows draw alike; an empty table gives an empty result. Only id,
source and text are read, so further columns of any name pass through ``emit`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Workspace, shuffle_parts, table, unit_hash

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20
#: Up to so many sources their rates are broadcast; above, the join is shuffled and AQE splits hot sources.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words of a text: ends of words, found by what follows them, so no array of words is made."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weighed(work: Workspace, sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sizes with w, the weights in turn by source: ranges of sources are numbered by themselves, from what the ranges before hold."""
    parts = work.keep(sizes.repartitionByRange(shuffle_parts(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    held = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).toLocalIterator())  # a number for each partition
    before, total = [], 0
    for part, n in held:
        before += [F.lit(part), F.lit(total)]
        total += n
    k = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    k = k + (F.create_map(*before)[F.col("part")] if before else F.lit(0))
    return parts.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int")).cast("long")).drop("part")


def source_targets(work: Workspace, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Water filling: what the sources at their caps leave is shared by weight; those whose share is above their cap stop at it, until
    none is. A round is one sum over the sources; all but the final division is whole numbers.
    """
    rows = work.keep(_weighed(work, sizes, weights).withColumn("capped", F.col("source_size") * cap), "weighed")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    total, all_w = rows.agg(exact("source_size"), exact("w")).first()
    left_size, left_w = int(total or 0), int(all_w or 0)
    big = "decimal(38,0)"
    while True:
        over = F.col("capped").cast(big) * F.lit(left_w).cast(big) < F.col("w").cast(big) * F.lit(left_size).cast(big)
        stopped, stopped_w = rows.where(over).agg(exact("capped"), exact("w")).first()
        now = int(total or 0) - int(stopped or 0), int(all_w or 0) - int(stopped_w or 0)
        if now == (left_size, left_w):
            break
        left_size, left_w = now
    shared = F.col("w") * F.lit(left_size) / F.lit(left_w)
    return rows.select("source", "source_size", F.when(over, F.col("capped").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, whole_rows: bool = False) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies; with whole_rows also all columns of docs, as struct ``row``."""
    work = Workspace(docs.sparkSession, "mix")
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")]
    sized = work.keep(docs.select(*columns), "sizes")
    targets = work.keep(source_targets(work, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    if whole_rows:
        sized = docs.select(*columns, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rated = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = (unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    copies = F.when(F.col("size") > 0, F.floor(rate).cast("long") + more).otherwise(F.lit(0).cast("long"))
    return rated.select(*sized.columns, "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The documents as often as the mix takes them, with copy_no from 1. No text is shuffled while the sources are few enough to broadcast."""
    mixed = mix(docs, whole_rows=True, **how).where("copies > 0")
    copies = mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
    return copies.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy_no"), "copy_no")


def op7_mix(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS capped FROM per
), ranked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(capped) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_size,
    (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_w,
    row_number() OVER o AS k
  FROM weighed WINDOW o AS (ORDER BY capped::DOUBLE / w, source NULLS LAST)
), cut AS (
  SELECT k AS k0, left_size AS s0, left_w AS w0 FROM ranked WHERE capped * left_w >= w * left_size ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN k < k0 THEN capped::DOUBLE ELSE (w * s0)::DOUBLE / w0 END AS target FROM ranked, cut
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT ELSE 0 END AS taken
FROM rated
"""

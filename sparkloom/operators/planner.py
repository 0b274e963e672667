"""Relevance scores, priorities, order and agent tasks of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls

MIN_CHUNK = 81_920
AGENTS = ("scout", "runtime", "naming", "security", "synthesizer")


def relevance(df: DataFrame, target: str = "target_url", url: str = "url", type_: str = "type", found: str = "discovered_from", size: str = "size_bytes") -> DataFrame:
    """df with score and priority."""
    u, t, origin_from = F.col(url), F.col(type_), F.lower(F.col(found))
    p, goal = urls.path(u), urls.path_tokens(urls.path(F.col(target)))
    plus = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    score = (
        F.when(urls.origin(u) == urls.origin(F.col(target)), 4).otherwise(-3)
        + plus(t.isin("wasm", "worker", "service-worker"), 4) + plus(t == "source-map", 3)
        + plus(origin_from.contains("html:script") | origin_from.contains("html:inline-script"), 3) + plus(origin_from.contains("iframe"), 3) + plus(origin_from.contains("form"), -2)
        + plus(F.col(size) > 350_000, 2) + plus(urls.is_auth_like(p), 7) + plus(urls.is_low_signal(p), -5) + plus(urls.is_sdk_host(urls.host(u)), -3)
        + F.size(F.filter(urls.path_tokens(p), lambda x: F.array_contains(goal, x))) * 4
    )
    return df.withColumn("score", score.cast("long")).withColumn("priority", priority(F.col("score")))


def priority(score: Column) -> Column:
    return F.when(score >= 12, "high").when(score >= 6, "medium").otherwise("low")


def analysis_rank(by: str, seq: str = "artifact_seq") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("size_bytes"), F.asc(seq)))


def chunk_bytes(context: Column) -> Column:
    return F.greatest(F.lit(MIN_CHUNK), F.floor(context * 0.9)).cast("long")


def agent_plan(level: Column, chunk: Column) -> Column:
    names = lambda *x: F.array(*map(F.lit, x))
    first = F.when(level == "high", names(*AGENTS)).when(level == "medium", names("scout", "runtime", "security", "synthesizer")).otherwise(names("scout", "synthesizer"))
    later = F.when(level == "high", names("runtime", "security", "synthesizer")).when(level == "medium", names("scout", "synthesizer")).otherwise(names("synthesizer"))
    return F.when(chunk == 0, first).otherwise(later)


def agent_tasks(level: Column, chunks: Column) -> Column:
    """Tasks of an artifact, without a row for each: its first chunk's and those of the others."""
    first = F.when(level == "high", 5).when(level == "medium", 4).otherwise(2)
    later = F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)
    return F.when(chunks > 0, first + (chunks - 1) * later).otherwise(0).cast("long")

"""Structured Streaming over arriving artifact and page files: an extension beyond the batch operators.

The stateless operators are plain column expressions, so they run on a stream as they are; counts of what they find are
windowed by arrival time under a watermark, so state is dropped when a window can change no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import flows, ordered, surface
from sparkloom.functions.text import clip
from sparkloom.functions.urls import absolute_rooted


def artifact_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def endpoint_stream(artifacts: DataFrame) -> DataFrame:
    """API literals of each arriving artifact, with methods and evidence; not yet unique over a run."""
    rows = ordered.matches(artifacts, "content", surface.API_PATTERN, {"raw": 1}, "run_id", "artifact_seq", "url", "arrived", windows={"methods_in": surface.NEAR_METHODS, "evidence_in": surface.NEAR_REST})
    return rows.select("run_id", "artifact_seq", "arrived", "match_seq", absolute_rooted(F.col("raw"), F.col("url")).alias("endpoint"), surface.method_hints(F.col("methods_in")).alias("methods"), clip(F.col("evidence_in")).alias("evidence"))


def first_endpoints(artifacts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each endpoint of a run once, as long as it arrives again within the watermark."""
    return endpoint_stream(artifacts.withWatermark("arrived", late)).dropDuplicatesWithinWatermark(["run_id", "endpoint"])


def signal_counts(artifacts: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How many artifacts with each fingerprinting rule arrived in each window."""
    hit = artifacts.withWatermark("arrived", late).select("arrived", F.explode(flows.hits(F.col("content"), flows.FINGERPRINT, flows.FINGERPRINT_NEEDLES)).alias("rule"))
    return hit.groupBy(F.window("arrived", every), "rule").agg(F.count("*").alias("artifacts"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)

"""The streaming extension gives what the batch operators give."""

from pyspark.sql import functions as F

from sparkloom.operators import flows, surface
from sparkloom.sources.synthetic import view
from sparkloom.streaming import artifacts as stream


def test_stream_equals_batch(spark, tmp_path):
    rows = view(spark, "/root/testdata/sf0.001", "artifacts").withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("artifact_seq") * 10))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    # file by file for the endpoints, whose order does not matter within a day; in one batch for the counts, so no row is late
    each, all_ = (stream.artifact_stream(spark, f"{tmp_path}/in", rows.schema, files_per_batch=n) for n in (1, 100))
    for k, df in enumerate((stream.first_endpoints(each, late="1 day"), stream.signal_counts(all_))):
        stream.write(df, f"{tmp_path}/out{k}", f"{tmp_path}/cp{k}").awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out0")
    want = surface.api_endpoints(rows, cap=10_000).select("run_id", "url").distinct()
    assert found.select("run_id", "endpoint").distinct().count() == found.count() == want.count()
    # windows that the watermark has closed are out, each with what the batch counts in it
    last = rows.agg(F.max("arrived")).first()[0]
    hit = rows.select("arrived", F.explode(flows.hits(F.col("content"), flows.FINGERPRINT, flows.FINGERPRINT_NEEDLES)).alias("rule"))
    closed = hit.groupBy(F.window("arrived", "10 minutes").alias("window"), "rule").agg(F.count("*").alias("artifacts")).where(F.col("window.end") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    counts = lambda df: {(r.window.start, r.rule): r.artifacts for r in df.collect()}
    got, want = counts(spark.read.parquet(f"{tmp_path}/out1")), counts(closed)
    assert got and want and all(got.get(k) == n for k, n in want.items()) and all(counts(hit.groupBy(F.window("arrived", "10 minutes").alias("window"), "rule").agg(F.count("*").alias("artifacts")))[k] == n for k, n in got.items())

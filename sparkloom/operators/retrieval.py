"""Lexical retrieval: segments, term weights, and top segments by dot product, scoped to an artifact."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import rag_tokens, segments
from sparkloom.sources.store import shared_dir

#: The last two are of agents' questions, which keep to them; the index takes whole ones.
SEGMENT, RESULTS, QUERY_CHARS, EXCLUDE_CHARS = 16384, 3, 6000, 256


def segment_rows(df: DataFrame, text: str, *by: str, size: int = SEGMENT) -> DataFrame:
    return df.select(*by, F.posexplode(segments(F.col(text), size)).alias("segment_index", "segment"))


def term_weights(segs: DataFrame, *by: str) -> DataFrame:
    """A row for each segment and token, with how often the segment holds it.

    Segments are dealt out as texts, which are far smaller than their tokens' rows, and rows of one key meet as texts; then tokens are sorted and counted
    within the key's row, so no token is shuffled or kept in a map. What is computed is in no filter, which would compute it once more.
    """
    keys = [*by, "segment_index"]
    met = segs.select(*keys, "segment").repartition(*keys).groupBy(*keys).agg(F.collect_list("segment").alias("_texts"))
    tokens = met.select(*keys, F.sort_array(F.flatten(F.transform("_texts", lambda t: rag_tokens(t)))).alias("_tokens"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_tokens") - 1), lambda i: (i == 0) | (F.get("_tokens", i) != F.get("_tokens", i - 1)))
    found = tokens.select(*keys, "_tokens", F.when(F.size("_tokens") > 0, starts).alias("_starts"))
    each = F.transform("_starts", lambda at, i: F.struct(F.get("_tokens", at).alias("token"), (F.coalesce(F.get("_starts", i + 1), F.size("_tokens")) - at).cast("long").alias("weight")))
    return found.select(*keys, F.explode_outer(each).alias("_x")).where("_x is not null").select(*keys, "_x.token", "_x.weight")


def query_weights(queries: DataFrame, *by: str) -> DataFrame:
    """A row for each query and token."""
    tokens = queries.select(*by, "query_id", F.explode(rag_tokens(F.col("query"))).alias("token"))
    return tokens.groupBy(*by, "query_id", "token").agg(F.count("*").alias("asked"))


def top_segments(segs: DataFrame, queries: DataFrame, *by: str, k: int = RESULTS) -> DataFrame:
    """by, query_id, segment_index, score, rank: the best k segments of the same artifact, by score and index. queries: by, query_id, query, exclude (may be null).

    Tokens of both sides meet by an equi-join within the artifact, which adaptive execution can split, and scores are sums, so a
    segment costs its tokens once however long the query is.
    """
    tokens = segs.select(*by, "segment_index", F.explode(rag_tokens(F.col("segment"))).alias("token"), F.lit(1).cast("long").alias("weight"))
    return _best(tokens, segs, queries, by, k)


def _best(terms: DataFrame, segs: DataFrame, queries: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    met = terms.join(query_weights(queries, *by), [*by, "token"])
    scored = met.groupBy(*by, "query_id", "segment_index").agg(F.sum(F.col("asked") * F.col("weight")).alias("score"))
    dropped = segs.join(queries.select(*by, "query_id", _unwanted().alias("exclude")).where("exclude is not null"), list(by)).where(F.col("segment").contains(F.col("exclude"))).select(*by, "query_id", "segment_index")
    scored = scored.join(dropped, [*by, "query_id", "segment_index"], "left_anti")
    return scored.withColumn("rank", _rank(by)).where(F.col("rank") <= k)


def _unwanted() -> Column:
    """What a segment may not hold, or null."""
    return F.nullif(F.trim("exclude"), F.lit(""))


def _rank(by: tuple[str, ...]) -> Column:
    return F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "segment_index"))


def _token_text(text: Column) -> Column:
    """The text's tokens, with what is repeated, parted by spaces, which no token holds."""
    return F.array_join(rag_tokens(text), " ")


#: Characters of queries whose counted tokens are remembered.
COUNTED_CHARS = 1 << 22


@F.arrow_udf(T.LongType())
def shared_weight(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of two token texts: for each token how often both hold it, multiplied, summed.

    Queries are whole texts, and a text's segments follow each other, so a query's tokens are counted for the first of them and looked up for the others:
    a text costs its tokens, not those times its segments. One row's tokens are held at a time, and the counts of the last queries.
    """
    known: dict[str, Counter] = {}
    chars = 0
    for asked, held in batches:
        out = []
        for few, many in zip(asked, held, strict=True):
            query = few.as_py() or ""
            if query not in known:
                chars += len(query)
                if chars > COUNTED_CHARS:
                    known, chars = {}, len(query)
                known[query] = Counter(query.split())
            out.append(sum(filter(None, map(known[query].get, (many.as_py() or "").split()))))
        yield pa.array(out, pa.int64())


class Index:
    """Segments with their tokens, written once in buckets of by. Any number of query batches meet them where they lie: of a batch the texts that count are exchanged,
    and a segment and a query are scored in their common row, so no token is a row that is shuffled, sorted or kept. ``drop`` when done; else the table's files stay in the shared folder.
    """

    def __init__(self, segs: DataFrame, *by: str, buckets: int | None = None):
        self.spark, self.by = segs.sparkSession, by
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        self.names = [f"sparkloom_segments_{uuid.uuid4().hex}"]
        dealt = segs.repartition(self.buckets, *by).withColumn("tokens", _token_text(F.col("segment")))
        dealt.write.format("parquet").option("compression", "zstd").option("path", self.root).bucketBy(self.buckets, *by).saveAsTable(self.names[0])
        self.segs = self.spark.table(self.names[0])

    def top(self, queries: DataFrame, k: int = RESULTS) -> DataFrame:
        """``top_segments`` of the stored ones. Rows of one key are added up, as scores are sums over tokens of either side."""
        by = self.by
        asked = queries.select(*by, "query_id", "query", _unwanted().alias("exclude")).repartition(self.buckets, *by)
        asked = asked.select(*by, "query_id", _token_text(F.col("query")).alias("asked"), "exclude")
        met = self.segs.join(asked.hint("merge"), list(by))
        unwanted = F.coalesce(F.col("segment").contains(F.col("exclude")), F.lit(False))
        each = met.select(*by, "query_id", "segment_index", shared_weight("asked", "tokens").alias("score"), unwanted.alias("unwanted"))
        scored = each.groupBy(*by, "query_id", "segment_index").agg(F.sum("score").alias("score"), F.bool_or("unwanted").alias("unwanted")).where("not unwanted").drop("unwanted")
        # without a common token a segment is no result; told last, as a filter below would score once more
        return scored.withColumn("rank", _rank(by)).where((F.col("rank") <= k) & (F.col("score") > 0))

    def drop(self) -> None:
        for known in self.names:
            self.spark.sql(f"DROP TABLE {known}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def with_segments(found: DataFrame, segs: DataFrame, *by: str) -> DataFrame:
    """top_segments with the segments' texts."""
    return found.join(segs.select(*by, "segment_index", "segment"), [*by, "segment_index"])


def describe(segs: DataFrame, *by: str) -> DataFrame:
    return segs.groupBy(*by).agg(F.count("*").alias("segments"))

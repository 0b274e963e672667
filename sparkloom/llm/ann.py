"""Approximate nearest neighbours by an inverted file and adaptive dimension scans.

Vectors are turned by a random rotation and dealt to lists (k-means on a bounded sample, ``TRAIN_ROWS``; every row is
indexed). There are about as many lists as the root of the rows: up to ``LISTS`` centers, and beyond a million rows each
center's list is cut by the nearest of a second set of centers, for what is left of a vector beside its first center, so
lists stay as small as the root whatever the rows. A query probes its nearest lists. Within a list the rotated coordinates
are scanned in column blocks: after d of D coordinates a candidate's distance is estimated as partial * sqrt(D / d), and
the hypothesis that it is within the tenth best so far is given up once the estimate exceeds that by the factor
1 + EPSILON / sqrt(d), so most candidates are left after a few blocks. Those that stay are measured on the original
vectors in double precision. The tenth best is known from each query's nearest list, scanned first, and tightens in each list
as rows are met.

How many lists to probe is set by measured recall: for ``TUNE_QUERIES`` of the queries the true neighbours over
all rows are found by brute force, and probes grow until their lists hold ``AIM`` of these; a query whose lists hold fewer
than k rows probes on until they do. Lists are cut in blocks of about twice the mean list and ``BLOCK_QUERIES`` queries,
so a list with a third of all rows is many tasks.

Defined cases: null vectors, zero vectors, those that hold null or non-finite components, rows with a null id and vectors
of another length than the most frequent one take no part, as candidates or queries; equal vectors are ordered by
id; with fewer candidates than k all are returned; rows that repeat an id are candidates each, but never for their own id,
and as queries share its ten; components may be as large as doubles are; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import Workspace, shuffle_parts, table

K = 10
LISTS = 1024
TRAIN_ROWS, ROUNDS = 20_000, 10
TUNE_QUERIES, AIM = 64, 0.98
LEAST_BLOCK, BLOCK_QUERIES = 256, 1_024
STEP, CHUNK = 16, 1_024
EPSILON = 3.0
#: Part of the squared norms that rotated distances may be off by.
SLACK = 1e-12
OUT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def matrix(column) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rotation(dim: int, seed: int = 4) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)
        empty = n == 0
        centers = np.where(empty[:, None], x[rng.choice(len(x), lists)], sums / np.maximum(n, 1)[:, None])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centers of each row, nearest first."""
    d = (centers * centers).sum(1)[None] - 2 * (x @ centers.T)
    if k == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, 1, kind="stable")[:, :k]


class Lists:
    """Rotation and centers: list a * len(fine) + b holds the vectors nearest to coarse[a] of which the rest is nearest to fine[b]."""

    def __init__(self, turn: np.ndarray, sample: np.ndarray, total: int):
        self.turn = turn
        x = sample @ turn
        wanted = max(1, int(np.sqrt(total)))
        self.coarse = kmeans(x, min(LISTS, wanted))
        fine = -(-wanted // len(self.coarse)) if wanted > LISTS else 1
        rest = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.fine = kmeans(rest, min(fine, LISTS), seed=6) if fine > 1 else np.zeros((1, x.shape[1]))
        self.count = len(self.coarse) * len(self.fine)
        self.beside = 2 * self.coarse @ self.fine.T + (self.fine * self.fine).sum(1)[None] + (self.coarse * self.coarse).sum(1)[:, None]

    def of(self, v: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        x = v @ self.turn
        a = nearest(x, self.coarse, 1)[:, 0]
        b = nearest(x - self.coarse[a], self.fine, 1)[:, 0] if len(self.fine) > 1 else 0
        return a * len(self.fine) + b

    def ordered(self, v: np.ndarray):
        """For each vector all lists, nearest first; a few vectors at a time, as each has a number for each list."""
        for start in range(0, len(v), step := max(1, 4_000_000 // self.count)):
            x = v[start : start + step] @ self.turn
            d = self.beside[None] - 2 * (x @ self.coarse.T)[:, :, None] - 2 * (x @ self.fine.T)[:, None, :]
            yield from np.argsort(d.reshape(len(x), -1), 1, kind="stable")


def scan(queries: np.ndarray, rows: np.ndarray, same: list[np.ndarray], k: int, bounds: np.ndarray | None = None) -> list[np.ndarray]:
    """For each rotated query the numbers of rows that stay: the k nearest and what the tests could not tell from them. same[q]: rows with the query's own id; bounds: squared distances within which its k nearest are known to lie."""
    dim = rows.shape[1]
    blocks = [(d, min(d + STEP, dim)) for d in range(0, dim, STEP)]
    largest = float((rows * rows).sum(1).max(initial=0))
    out = []
    for n, (q, own) in enumerate(zip(queries, same, strict=True)):
        bound = np.inf if bounds is None else float(bounds[n])
        slack = SLACK * (float(q @ q) + largest)
        best = np.zeros(0)  # squared distances of the nearest k so far
        kept, partials = [], []
        edges = [0, *range(min(len(rows), max(4 * k, 64)), len(rows), CHUNK), len(rows)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            alive = np.arange(lo, hi)
            alive = alive[~np.isin(alive, own)] if len(own) else alive
            partial = np.zeros(len(alive))
            for a, b in blocks:
                if not len(alive):
                    break
                delta = rows[alive, a:b] - q[a:b]
                partial = partial + (delta * delta).sum(1)
                if bound < np.inf:
                    limit = bound if b == dim else bound * (b / dim) * (1 + EPSILON / np.sqrt(b)) ** 2
                    stay = partial <= limit + slack
                    alive, partial = alive[stay], partial[stay]
            kept.append(alive)
            partials.append(partial)
            best = np.sort(np.concatenate((best, partial)))[:k]
            if len(best) == k:
                bound = min(bound, float(best[-1]) * (1 + 1e-9))
        near = np.concatenate([*partials, np.zeros(0)]) <= bound + slack
        out.append(np.concatenate([*kept, np.zeros(0, np.int64)])[near])
    return out


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean, also where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        delta = rows - query
        d = np.sqrt((delta * delta).sum(1))
    far = np.flatnonzero((~np.isfinite(d) | (d < 1e-150)) & (delta != 0).any(1))
    for k in far:
        most = np.abs(delta[k]).max()
        d[k] = most * np.sqrt(((delta[k] / most) ** 2).sum()) if np.isfinite(most) else np.inf
    return d


def _best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest, by distance and id."""
    d = distances(query, rows)
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    return rows.where(~bad & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on ``id``."""
    spark = vectors.sparkSession
    sc, work = spark.sparkContext, Workspace(spark, "ann")
    rows = usable(vectors, id_col, vec_col)
    most = F.max(F.array_max(F.transform("v", F.abs)))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), most.alias("most")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, most = sizes
    scale = 1.0 if 1e-100 < most < 1e100 else 1 / max(most, 1e-300)  # squares stay in the range of doubles
    rows = rows.where(F.size("v") == dim)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("v").toArrow()
    lists = Lists(rotation(dim) * scale, matrix(some.column("v")), total)
    index = sc.broadcast(lists)  # at most 2 * LISTS centers, dim * dim numbers, and one for each list

    @F.arrow_udf(T.IntegerType())
    def list_of(v: pa.Array) -> pa.Array:
        return pa.array(index.value.of(matrix(v)).astype(np.int32))

    dealt = work.keep(rows.select("id", "v", list_of("v").alias("list")), "dealt")
    queries = dealt.where(is_query)
    probes = _tune(dealt, queries, lists, k)
    per_list = dealt.groupBy("list").agg(F.count("*").alias("n"))
    counted = np.zeros(lists.count, np.int64)
    for x in per_list.toLocalIterator():  # as many as there are lists
        counted[x["list"]] = x["n"]
    repeats = queries.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    held = sc.broadcast(counted)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lists_of(v: pa.Array) -> pa.Array:
        out = []
        for near in index.value.ordered(matrix(v)):
            rows_met = np.cumsum(held.value[near])
            n = max(probes, int(np.searchsorted(rows_met, k + repeats)) + 1)  # its own rows are no candidates
            near = near[:n]
            out.append(np.concatenate((near[:1], near[1:][held.value[near[1:]] > 0])).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    asked = work.keep(queries.select("id", "v", F.posexplode(lists_of("v")).alias("place", "list")), "asked")
    block = max(LEAST_BLOCK, 2 * total // lists.count)

    def meet(asking: DataFrame, name: str) -> DataFrame:
        """(query_id, vec_id, score) of the nearest in the lists asked."""
        # a row for each list: into how many blocks its rows and its queries go
        shape = per_list.select("list", F.ceil(F.col("n") / block).cast("int").alias("rs")).join(asking.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qs")), "list")
        shape = F.broadcast(work.keep(shape, "shape"))  # as many rows as there are lists
        own, other = F.pmod(F.xxhash64("id"), F.col("rs")), F.pmod(F.xxhash64("id"), F.col("qs"))
        left = dealt.join(shape, "list").select("list", own.cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "id", "v")
        right = asking.join(shape, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"), other.cast("int").alias("q"), "id", "v", "bound")
        by = ("list", "r", "q")
        return work.keep(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, OUT), name)

    def compare(block: pa.Table, asking: pa.Table) -> pa.Table:
        if not block.num_rows or not asking.num_rows:
            return _OUT.empty_table()
        turn = index.value.turn
        ids, raw, asks, points = block.column("id").to_numpy(), matrix(block.column("v")), asking.column("id").to_numpy(), matrix(asking.column("v"))
        order = np.lexsort((np.arange(len(ids)), ids))
        ids, raw = ids[order], raw[order]
        lo, hi = np.searchsorted(ids, asks), np.searchsorted(ids, asks, "right")
        bounds = (asking.column("bound").to_numpy() * scale) ** 2 * (1 + 1e-9)
        stay = scan(points @ turn, raw @ turn, [np.arange(x, y) for x, y in zip(lo, hi, strict=True)], k, bounds)
        found = [(a, *_best(p, raw[at], ids[at], k)) for a, p, at in zip(asks, points, stay, strict=True)]
        return pa.table([np.repeat(asks, [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])], schema=_OUT)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    first = meet(asked.where("place = 0").withColumn("bound", F.lit(float("inf"))), "nearest")
    # of queries that share an id the one that knows least counts
    bound = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.when(F.lit(repeats <= 1), F.col("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    others = asked.where("place > 0").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    met = first.union(meet(others, "others"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, asked: list[tuple[int, list[float]]], k: int = K) -> DataFrame:
    """(query_id, list, vec_id, score): the true k nearest of a few given queries, in one pass; rows: id, v, list."""
    shared = rows.sparkSession.sparkContext.broadcast(([q for q, _ in asked], np.array([v for _, v in asked], np.float64)))

    def run(batches):
        asks, points = shared.value
        for batch in batches:
            ids, x, lists = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for q, p in zip(asks, points, strict=True):
                others = np.flatnonzero(ids != q)
                d = distances(p, x[others])
                at = np.lexsort((ids[others], d))[:k]
                out.append((np.full(len(at), q), lists[others[at]], ids[others[at]], d[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "list", "vec_id", "score"])

    near = rows.select("id", "v", "list").mapInArrow(run, "query_id long, list int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _tune(dealt: DataFrame, queries: DataFrame, lists: Lists, k: int) -> int:
    """Probes whose lists hold AIM of the true neighbours of a bounded sample of the queries."""
    some = [(x["id"], x["v"]) for x in queries.orderBy(F.xxhash64("id"), "id").limit(TUNE_QUERIES).collect()]
    if not some:
        return 1
    place = {}
    for (q, _), near in zip(some, lists.ordered(np.array([v for _, v in some], np.float64)), strict=True):
        place[q] = np.argsort(near)
    at = np.sort([place[x["query_id"]][x["list"]] for x in brute_force(dealt, some, k).collect()])
    return int(at[min(len(at) - 1, int(np.ceil(AIM * len(at))))]) + 1 if len(at) else 1


def op4_nearest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)

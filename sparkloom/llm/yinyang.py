"""Exact centroid clustering with Yinyang bounds.

Vectors are scaled to whole numbers, so sums, means and squared distances are exact and no result hangs on an order of
adding. The centroids are put into groups once. Each vector keeps an upper bound of the distance to its centroid and one lower
bound for each group, and a round is one pass: bounds widen by how far centroids moved; a vector whose least lower bound is above
its upper bound is done (global filter); then whole groups fall out by their bounds, then single centroids by the group's
old bound and their own move, and what is left is measured exactly. A centroid is left out only if it is surely farther,
by a margin for rounding, so equal distances are always measured and go to the smaller number.

The vectors are written once, as a table in buckets of row numbers; the bounds are a table with the same buckets, written
anew each round, so a round joins them without an exchange and writes a tenth of the vectors' bytes. A task adds
up what its moved vectors bring to and take from their centroids, and stores that with its bounds, so a lost and repeated task counts
once. The driver only sees the k sums of a round. It stops early when no centroid moves, as all later rounds are alike then.

Defined cases: vectors that are null, of another length than ``dim``, or that hold a null or a non-finite component take no part;
rows that repeat an id, or have none, are vectors each; equal vectors share a centroid; with fewer vectors than ``k`` each starts
a centroid; an empty table gives an empty result. A component of ``MOST / scale`` or more in magnitude is an error, as squared distances
would leave 64 bits. Only the id and the vector are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, parts_for, table

K, DIM, ROUNDS, SEED, SCALE = 8, 64, 10, 3, 1024
#: Scaled components stay below this, so 64 squares of differences fit in 64 bits.
MOST = 2**27
#: Part of a bound that rounding may take.
MARGIN = 1e-9
#: Lower bounds of so many vectors times centroids are held at once.
CELLS = 2_000_000
MOST_BUCKETS = 100_000
POINTS = "vec_id long, v binary"
STATE = "rid long, cluster int, upper double, lower binary, moved array<struct<c:int,s:array<long>>>"
_STATE = pa.schema([("rid", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("moved", pa.list_(pa.struct([("c", pa.int32()), ("s", pa.list_(pa.int64()))])))])


@dataclass(frozen=True)
class Clustering:
    """assigned: (vec_id, cluster, distance); centroids: their whole components by number; sizes and inertias by number; measured: distances
    that were computed in all rounds, of vectors * k * passes that plain rounds take."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertias: list[int]
    measured: int
    passes: int


def scaled(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(scale * x) of those that do."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    x = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(x).all(1)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite]
    x = np.floor(scale * x[finite])
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component is {MOST // scale} or more in magnitude, beyond exact 64-bit distances")
    return rows, x.astype(np.int32)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids alone, from the first ones."""
    c = centroids.astype(float)
    heads = c[:groups].copy()
    for _ in range(rounds):
        of = ((c[:, None] - heads[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                heads[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, old: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its bounds by now, and how many distances were measured.

    old, upper, lower: from the centroids before, which moved by drift at most; of: the group of each centroid.
    """
    far = np.array([drift[of == g].max() for g in range(lower.shape[1])])
    before, lower = lower, lower - far
    new, upper = old.copy(), upper + drift[old]
    beyond = lambda bound, limit: bound > limit * (1 + MARGIN) + MARGIN
    rest = np.flatnonzero(~beyond(lower.min(1), upper))
    own = _squared(x[rest], centroids[old[rest]])
    measured = len(rest)
    upper[rest] = np.sqrt(own)
    still = ~beyond(lower[rest].min(1), upper[rest])
    rest, own = rest[still], own[still]
    for at in range(0, len(rest), step := max(1, CELLS // len(centroids))):
        i, d = rest[at : at + step], own[at : at + step]
        mine, best, n = old[i], upper[i].copy(), np.arange(len(i))
        exact = np.full((len(i), len(centroids)), np.iinfo(np.int64).max)
        bounds = lower[i][:, of]
        exact[n, mine], bounds[n, mine] = d, best
        for c in range(len(centroids)):
            group = ~beyond(lower[i, of[c]], best) & (mine != c)
            alone = before[i, of[c]] - drift[c]
            bounds[group, c] = alone[group]
            left = np.flatnonzero(group & ~beyond(alone, best))
            exact[left, c] = _squared(x[i[left]], centroids[c][None])
            bounds[left, c] = np.sqrt(exact[left, c])
            best[left] = np.minimum(best[left], bounds[left, c])
            measured += len(left)
        new[i] = exact.argmin(1)
        upper[i] = np.sqrt(exact[n, new[i]])
        bounds[n, new[i]] = np.inf
        for g in range(lower.shape[1]):
            lower[i, g] = bounds[:, of == g].min(1)
    return new, upper, lower, measured


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def _encoder(dim: int, scale: int):
    def encode(batches):
        for batch in batches:
            rows, x = scaled(batch.column(1), dim, scale)
            blobs = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "v"])

    return encode


def _bounds(batch: pa.RecordBatch, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    if "cluster" not in batch.schema.names:  # nothing is known yet
        return np.zeros(n, np.int32), np.full(n, np.inf), np.full((n, groups), -np.inf)
    lower = np.frombuffer(b"".join(batch.column("lower").to_pylist())).reshape(n, groups)
    return batch.column("cluster").to_numpy().astype(np.int32), batch.column("upper").to_numpy(), lower


def _passes(centroids: np.ndarray, drift: np.ndarray, of: np.ndarray):
    groups = int(of.max()) + 1

    def step(batches):
        held, measured, sums = None, 0, np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, centroids.shape[1])
            first = "cluster" not in batch.schema.names
            old, upper, lower = _bounds(batch, groups)
            new, upper, lower, n = assign(x, old, upper, lower, centroids, drift, of)
            measured += n
            change = np.flatnonzero(new != old) if not first else np.arange(len(new))
            for sign, side in ((1, new), (-1, old))[: 1 if first else 2]:
                for c in np.unique(side[change]):
                    rows = change[side[change] == c]
                    sums[c, 0] += sign * len(rows)
                    sums[c, 1:] += sign * x[rows].sum(0)
            if held:
                yield _state(held)
            held = [batch.column("rid"), pa.array(new.astype(np.int32)), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary())]
        if held:  # the task's sums stand in its last row
            yield _state(held, [(-1, [measured]), *((c, sums[c].tolist()) for c in np.flatnonzero(sums.any(1)).tolist())])

    return step


def _state(columns: list[pa.Array], sums: list[tuple[int, list[int]]] | None = None) -> pa.RecordBatch:
    moved = [None] * (len(columns[0]) - 1) + [sums and [{"c": c, "s": s} for c, s in sums]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(moved, _STATE.field("moved").type)], schema=_STATE)


def _last(centroids: np.ndarray, drift: np.ndarray, of: np.ndarray):
    groups = int(of.max()) + 1

    def step(batches):
        for batch in batches:
            x = _vectors(batch, centroids.shape[1])
            new = assign(x, *_bounds(batch, groups), centroids, drift, of)[0] if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(new.astype(np.int32)), pa.array(_squared(x, centroids[new]))], names=["vec_id", "cluster", "distance"])

    return step


class _Buckets:
    """Tables of one number of buckets by rid, as files in the workspace; joins of two of them need no exchange."""

    def __init__(self, work: Workspace, n: int):
        self.work, self.spark, self.n, self.held = work, work.spark, n, {}

    def write(self, df: DataFrame, name: str) -> str:
        known, at = f"sparkloom_{name}_{uuid.uuid4().hex}", self.work.path(name)
        df.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(self.n, "rid").saveAsTable(known)
        self.held[known] = at
        return known

    def drop(self, known: str) -> None:
        self.spark.sql(f"DROP TABLE {known}")
        self.work.delete(self.held.pop(known))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, groups: int | None = None) -> Clustering:
    """Lloyd's rounds from the k vectors whose sha256 of ``<seed>:<id>`` is least; groups of centroids: about the root of k if not given."""
    spark = vectors.sparkSession
    work = Workspace(spark, "yinyang")
    buckets = _Buckets(work, min(MOST_BUCKETS, parts_for(vectors)))
    encoded = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(_encoder(dim, scale), POINTS)
    points = buckets.write(encoded.withColumn("rid", F.monotonically_increasing_id()).repartition(buckets.n, "rid"), "points")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = spark.table(points).orderBy(key, "v").limit(k).select("v").collect()
    if not starts:
        buckets.drop(points)
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [], 0, 0)
    now = np.array([np.frombuffer(r.v, np.int32) for r in starts]).astype(np.int64)
    of = grouped(now, min(len(now), groups or max(2, round(len(now) ** 0.5))))
    sums, counts, drift, state, measured, passes = [[0] * dim for _ in now], [0] * len(now), np.zeros(len(now)), None, 0, 0
    both = lambda: spark.table(points) if state is None else spark.table(points).join(spark.table(state).hint("shuffle_hash").drop("moved"), "rid")
    for _ in range(rounds):
        done = buckets.write(both().mapInArrow(_passes(now, drift, of), STATE), "bounds")
        if state is not None:
            buckets.drop(state)
        state, passes = done, passes + 1
        moved = spark.table(state).where("moved is not null").select(F.explode("moved").alias("m")).select("m.c", "m.s")
        for c, *found in moved.groupBy("c").agg(*(F.sum(F.get("s", i)).alias(f"s{i}") for i in range(dim + 1))).collect():  # k rows
            if c < 0:
                measured += found[0]
            else:
                counts[c] += found[0]
                sums[c] = [a + b for a, b in zip(sums[c], found[1:], strict=True)]
        after = np.array([[s // n for s in row] if n else list(map(int, was)) for row, n, was in zip(sums, counts, now, strict=True)], np.int64)
        drift = np.sqrt(_squared(after, now).astype(float)) * (1 + MARGIN)
        now = after
        if not drift.any():
            break
    assigned = work.keep(both().mapInArrow(_last(now, drift, of), "vec_id long, cluster int, distance long"), "assigned")
    if state is not None:
        buckets.drop(state)
    buckets.drop(points)
    per = {c: s for c, s in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    return Clustering(assigned, now.tolist(), [int(per.get(c, 0)) for c in range(len(now))], measured, passes)


def op11_centroids(spark, sf_dir):
    got = cluster(table(spark, sf_dir, "embeddings"))
    facts = [(c, inertia, sum(got.inertias), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, (inertia, v) in enumerate(zip(got.inertias, got.centroids, strict=True))]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return got.assigned.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """Every round spelled out: all distances, then exact means."""
    nearest = """a{r} AS MATERIALIZED (SELECT rid, v, arg_min(c, (d, c)) AS cluster, min(d) AS d FROM (
    SELECT p.rid, p.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - m.v[i]) * (p.v[i] - m.v[i])))::BIGINT AS d FROM points p, c{r} m) GROUP BY rid, v)"""
    means = """c{n} AS MATERIALIZED (SELECT c{r}.c, coalesce(u.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster) u ON u.cluster = c{r}.c)"""
    steps = [
        """points AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM points ORDER BY h, v LIMIT {K}))""",
    ]
    for r in range(rounds):
        steps += [nearest.format(r=r), means.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return f"""WITH {", ".join(steps)}
SELECT p.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN points p ON p.rid = a.rid JOIN c{rounds} m ON m.c = a.cluster"""


ORACLE = _oracle()

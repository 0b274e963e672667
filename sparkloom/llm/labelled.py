"""Labelled rows for training: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace

#: A classifier is fitted on at most so many labelled documents, the first by a hash of their ids, of at most so many bytes together.
TRAIN_ROWS = 4000
TRAIN_BYTES = 64_000_000


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, rows: int = TRAIN_ROWS, id_col: str = "doc_id", limit: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """Up to rows (text in UTF-8, label) whose id passes teaches; ids labelled both ways are left out.

    Texts are whole. They are taken in order of a hash of their ids; one that would bring the sample beyond limit bytes is passed over.
    """
    work = Workspace(docs.sparkSession, "sample")
    known = labels.where(F.col(label).isin(0, 1) & teaches).groupBy(id_col).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
    chosen = known.where("_y = _z").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows).drop("_z")
    text = F.coalesce("text", F.lit("")).cast("binary")
    pairs = docs.select(id_col, text.alias("t")).join(F.broadcast(chosen), id_col).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64("t").alias("k"), "t", "_y")
    pairs = work.keep(pairs, "pairs")
    held, left, wanted = [], limit, set()
    for h, k, n in pairs.groupBy("h", "k").agg(F.max(F.length("t")).alias("n")).orderBy("h", "k").limit(rows).toLocalIterator():
        if n <= left:
            left -= n
            wanted.add((h, k))
    if wanted:
        few = docs.sparkSession.createDataFrame(sorted(wanted), "h long, k long")
        for h, k, t, y in pairs.join(F.broadcast(few), ["h", "k"]).dropDuplicates(["h", "k"]).toLocalIterator():
            held.append((h, k, bytes(t), int(y)))
    work.drop(pairs)
    return [(t, y) for _, _, t, y in sorted(held)]

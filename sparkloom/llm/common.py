"""What the training-data operators share: tables, scratch space on the shared store, text rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to differ from all columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive lost executors.

    They go when no longer read; what a lazy result still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)  # only what exists can be marked
        fs.deleteOnExit(at)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written once and read back."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._kept_at = at
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.delete(df._kept_at)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int = 64_000_000) -> int:
    """Partitions for a shuffle whose tasks gather their rows: the session's number, or one for so many bytes of input if that is more.

    The size is the planner's estimate, so nothing is read for it; an unknown size leaves the session's number.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_parts(df.sparkSession), size // each if size < 2**60 else 0)


def unit_hash(col, seed: int):
    """A repeatable number in [0, 1) from the column's text and a seed: the first 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))

"""Reading tables and preparing their partitions."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """The same rows in at least `waves` partitions a core.

    Work in Python is bound by CPU, not by bytes, so a small file that Spark reads as one partition would keep one core
    busy. Inputs that already have as many partitions (every large one) pass unchanged and aren't shuffled. What counts are
    the partitions of the scan: the frame isn't planned, let alone run, to know them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if _scanned_partitions(df) >= cores * waves else df.repartition(cores * (waves + 1))


def _scanned_partitions(df: DataFrame) -> int:
    """How many partitions the scans of the files behind a frame have, by their sizes; 0 if there are no files."""
    conf, sc = df.sparkSession.conf, df.sparkSession.sparkContext
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()) if "LogicalRelation" in leaves.apply(i).getClass().getName())
    most = int(sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b")))
    if size >= most * sc.defaultParallelism:
        return size // most
    opening = 4 << 20  # what opening a file counts for
    files = len(df.inputFiles()) if size else 0
    each = min(most, max(opening, (size + files * opening) / sc.defaultParallelism))
    return int((size + files * opening) // each) if files else 0


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows of a table of (key, text). Only keys and hashes of texts are shuffled, and the texts of keys that repeat.

    A key that stands once is a distinct row. The repeated keys are counted first; while there are at most BROADCAST_KEYS of
    them, they are sent to the scan, which keeps all other rows where they are.
    """
    value = [c for c in df.columns if c != key]
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    seen = Observation()
    repeated = checkpointed(repeated.observe(seen, F.count(F.lit(1)).alias("n")))
    side = F.broadcast(repeated) if seen.get["n"] <= BROADCAST_KEYS else repeated
    same = F.col(key).eqNullSafe(F.col("__key"))
    once = df.join(side, same, "left_anti")
    again = df.join(side, same, "left_semi").groupBy(key, F.xxhash64(*value).alias("__h"), F.md5(F.concat_ws("\u0001", *value)).alias("__m")).agg(*[F.first(c).alias(c) for c in value])
    return spread(once).unionByName(again.select(*df.columns)).select(*df.columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder that the session names (spark.checkpoint.dir)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="vellumflow-")  # tests and single machines only
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()

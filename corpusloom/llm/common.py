"""Shared plumbing: the shared folder, written tables, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        context = spark.sparkContext
        java = context._jsc.sc().getCheckpointDir()
        if java.isDefined():
            return java.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        context.setCheckpointDir(got)
        return context._jsc.sc().getCheckpointDir().get()
    return got


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._corpusloom_sent = True


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder, for tasks that read or write files of their own there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Cut lineage: write `df` once in the shared folder and read it back.

    A lost executor then costs only the tasks it ran.  After a `large` one, collecting garbage lets Spark drop the shuffle
    files behind it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    del df
    if large:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def gathered(df: DataFrame) -> DataFrame:
    """`df` in at most three tasks a core, for tables with a row or less for many rows of their input: partitions are joined as they are, so nothing is shuffled."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


#: Bytes of a batch that goes to a Python worker: a task holds several copies of one, both beside the JVM's heap and in the worker.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES; a longer row is a batch of its own.

    Spark reads the bound when the plan runs, so it holds for the session from here on; a smaller one of the session's own stays.
    """
    spark = df.sparkSession
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def discard(*frames: DataFrame) -> None:
    """Delete tables that `written` made and nobody will read again."""
    for df in frames:
        remove(df.sparkSession, df._written_to)


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps; each is a grouped minimum (partial aggregation) and a join.  The minimum is a
    written table before the join, so both sides of the join are plain exchanges, and a hub with millions of links is split
    as a skewed key.  It ends when every node has one edge to a node that has none to a smaller one, which one grouped count
    over the nodes shows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    for _ in range(rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        # one row for each edge at most, so repeats may wait for the end of the round
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        step = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        last, now = now, written(step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        discard(last, low, large, least)
    else:
        raise RuntimeError("components: no fixed point")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)

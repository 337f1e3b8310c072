"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own for a local master, an error for others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffles of an execution leave the disk as it ends: what a write has made is read from its files, never from them.
DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Tables dealt by some of a join's keys are joined where they lie.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def setting(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside, for what is planned and run there."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table that every later plan reads alike, whatever executors are lost."""
    path = fresh(df.sparkSession, name)
    with setting(df.sparkSession, DROPPED):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_sent", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._corpusloom_sent = True

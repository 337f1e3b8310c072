"""Digests of tables that add up over any partitions, and what they locate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lanes of a row's SHA-512, each of 64 bits, added modulo 2**64.
LANES, SPAN = 8, 1 << 64


def row_digest(*columns: str) -> Column:
    """SHA-512 of a row in hex; nulls count, and so do the names of columns, sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 512)


def lanes(row: Column) -> list[Column]:
    """Sums of the lanes of all rows' digests."""
    lane = lambda i: F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.sum(lane(i)).cast("decimal(38,0)").alias(f"_{i}") for i in range(LANES)]


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows as a multiset: partial sums by task, so neither order nor partitions matter and nothing is gathered.

    Lanes are added modulo 2**64 by batch; what leaves a batch are their halves, so that sums of any number of batches stay whole.
    """
    import pyarrow as pa

    halves = [f"_{i}{h}" for i in range(LANES) for h in ("high", "low")]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in filter(len, batches):
            rows = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), ">u8").astype(np.uint64).reshape(-1, LANES)
            sums = [int(x) for x in rows.sum(0, dtype=np.uint64)]
            parts = [batch.num_rows, *(x for s in sums for x in (s >> 32, s & 0xFFFFFFFF))]
            yield pa.record_batch([pa.array([x], pa.int64()) for x in parts], names=["n", *halves])

    made = df.select(row_digest(*df.columns).alias("_row")).mapInArrow(added, ", ".join(f"{c} long" for c in ["n", *halves]))
    row = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *halves])).first()
    text = ",".join([str(row["n"]), *(f"{((row[f'_{i}high'] << 32) + row[f'_{i}low']) % SPAN:016x}" for i in range(LANES))])
    return hashlib.sha256(text.encode()).hexdigest()


def key_digests(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, digest): the multiset digest of the rows of each key."""
    rest = [c for c in df.columns if c not in keys]
    made = df.select(*keys, F.explode(F.array(row_digest(*rest))).alias("_row"))
    sums = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes(F.col("_row")))
    text = F.concat_ws(",", F.col("n").cast("string"), *(F.pmod(F.col(f"_{i}"), F.lit(Decimal(SPAN))).cast("string") for i in range(LANES)))
    return sums.select(*keys, "n", F.sha2(text, 256).alias("digest"))


def differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, left_n, right_n) of the keys whose rows differ; 0 where one side has none."""
    a = key_digests(left, *keys).select(*keys, F.col("n").alias("left_n"), F.col("digest").alias("_a"))
    b = key_digests(right, *keys).select(*keys, F.col("n").alias("right_n"), F.col("digest").alias("_b"))
    met = a.join(b, list(keys), "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return met.select(*keys, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))

"""What the two vector operators share: valid vectors, shards and blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block at most; small tables get LEAST_SHARDS.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS = 200_000, 16_384, 6


def finite(vector: str) -> Column:
    """A vector without null or non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def count_of(rows: int, each: int, least: int) -> int:
    return max(least, -(-rows // each))


def matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.array(column.tolist(), kind) if len(column) else np.zeros((0, 1), kind)


def dealt(df: DataFrame, name: str, parts: int, *columns: str) -> DataFrame:
    """A part number by a hash of columns."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(name), *columns), F.lit(parts)).cast("int"))

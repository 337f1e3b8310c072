"""Operator 5: exact top-k inner products by KD-trees, one per shard.

Trees split at the median of the widest side and keep tight boxes.  A query visits boxes in the order of their bound
(the largest inner product any point of the box can have) and stops when the bound falls below its k-th score;
equal bounds go on, as ties go to the smaller id.  Each query first searches one shard; its k-th score then
travels with it to all other shards and prunes them from the start.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import BLOCK_ROWS, LEAST_SHARDS, SHARD_ROWS, count_of, dealt, finite, matrix

LEAF = 256
#: Products and sums of whole numbers stay exact in a double below the first; no long holds the second.
EXACT, LONGS = float(1 << 53), 1 << 63


class Tree:
    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(x))
        self.low, self.high, self.child, self.span = [], [], [], []
        self.x = x
        self.grow(0, len(x))
        self.x, self.ids = x[self.order], ids[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def grow(self, i: int, j: int) -> int:
        """Median splits of rows i..j, without recursion deeper than the tree."""
        part = self.x[self.order[i:j]]
        node = len(self.child)
        self.low.append(part.min(0))
        self.high.append(part.max(0))
        self.child.append(None)
        self.span.append((i, j))
        if j - i > LEAF:
            side = int((self.high[node] - self.low[node]).argmax())
            if self.high[node][side] > self.low[node][side]:
                mid = (j - i) // 2
                self.order[i:j] = self.order[i:j][np.argpartition(part[:, side], mid)]
                self.child[node] = (self.grow(i, i + mid), self.grow(i + mid, j))
        return node

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each box."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        return self.x[a:b] @ q

    def top(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The best k (score, -id) of each query above or at its k-th score so far, without rows of its own id."""
        out = []
        bounds = self.bounds(q)
        for i in range(len(q)):
            best: list[tuple[float, int]] = []
            least = kth[i]
            queue = [(-bounds[i, 0], 0)]
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < least:
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        if bounds[i, c] >= least:
                            heapq.heappush(queue, (-bounds[i, c], c))
                    continue
                a, b = self.span[node]
                score = self.scores(a, b, q[i])
                for r in np.flatnonzero(score >= least):
                    if self.ids[a + r] != own[i]:
                        one = (score[r], -int(self.ids[a + r]))
                        if len(best) < k:
                            heapq.heappush(best, one)
                        elif one > best[0]:
                            heapq.heapreplace(best, one)
                        if len(best) == k:
                            least = max(least, best[0][0])
            out.append(best)
        return out


class WideTree(Tree):
    """For components whose products a double cannot hold: boxes bound in doubles, widened by their rounding; scores are exact whole numbers."""

    def bounds(self, q: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.abs(q) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
            out = super().bounds(q) + most * 1e-12
        return np.where(np.isnan(out), np.inf, out)

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        whole = [int(y) for y in q]
        out = np.empty(b - a, object)
        out[:] = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in self.x[a:b]]
        return out


def top_k(table: DataFrame, every: int = 50, scale: int = 256, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of all other rows for each row whose vec_id is divisible by `every`.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id or vectors of
    another length than the query's.  Rows that share the query's vec_id are its own; an empty table gives no rows.
    Scores are exact whole numbers whatever the components; one beyond a long is the nearest long, and ranks as that.  Of rows that
    share a vec_id, the one with the smallest vector asks.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(finite("v") & F.col("vec_id").isNotNull())
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**52 / scale), F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale))
    rows = rows.withColumn("v", F.transform("v", whole)).where(finite("v")).withColumn("dim", F.size("v"))
    rows = written(rows, "vectors")
    n = rows.count()
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select(F.col("id").alias("id"), F.col("x.v").alias("v"), F.col("x.dim").alias("dim"))
    asked = written(asked, "asked")
    shards, blocks = count_of(n, SHARD_ROWS, LEAST_SHARDS), count_of(-(-n // every), BLOCK_ROWS, 1)
    points = dealt(rows, "shard", shards, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = dealt(dealt(asked, "block", blocks, "id"), "home", shards, "id")

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple[int, int, int]] = []
        if len(q) and len(p):
            x, y = matrix(p["v"], np.float64), matrix(q["v"], np.float64)
            with np.errstate(over="ignore"):
                kind = Tree if np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT else WideTree
            own, kth = q["id"].to_numpy(np.int64), q["kth"].to_numpy(np.float64)
            for i, best in enumerate(kind(x, p["id"].to_numpy(np.int64)).top(y, own, np.where(np.isnan(kth), -np.inf, kth), k)):
                got += [(int(own[i]), -v, max(-LONGS, min(LONGS - 1, int(s)))) for s, v in best]
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    def run(queries: DataFrame) -> DataFrame:
        by = ["dim", "shard", "block"]
        queries = queries.select("dim", "shard", "block", "id", "v", "kth")
        return queries.groupBy(*by).cogroup(points.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score long")

    first = written(run(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("double"))), "home")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    rest = asked.join(kth, asked["id"] == kth["query_id"], "left").drop("query_id").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = first.unionByName(run(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")

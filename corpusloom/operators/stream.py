"""One ordered stream over all units: running sums, windows and interval owners without a task that holds it.

Rows are range-partitioned by the stream's order and written with their partition.  What crosses partitions is small: sums of each, a row
a partition, and for windows the first rows of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

PART = "_part"


def dealt(rows: DataFrame, order: Sequence[str], name: str = "stream") -> DataFrame:
    """`rows` written in ranges of `order`, with the number of their range."""
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()), name)


def running(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """`rows` with, for each name of `sums`, the sum of that column over all rows before this one in `order`: a two-level prefix scan.

    `order` must tell rows apart; nulls come first and count as 0.  Sums inside a range are made as it is written, so rows are shuffled once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = list(sums)
    ready = rows.withColumns({f"_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()})
    ready = ready.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    schema = T.StructType([*ready.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = [0] * len(names)
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(batch.schema.names.index(f"_{n}")) for n in names]
                to = [pc.cumulative_sum(c, start=u) for c, u in zip(own, upto, strict=True)]
                upto = [c[-1].as_py() for c in to]
                yield pa.record_batch([*batch.columns, *(pc.subtract(t, c) for t, c in zip(to, own, strict=True))], names=[*batch.schema.names, *names])

    ready = written(ready.mapInArrow(scan, schema), "stream")
    totals = ready.groupBy(PART).agg(*(F.sum(f"_{n}").alias(n) for n in names)).collect()  # a row a partition
    out = ready.join(bases(ready, totals, names), PART).withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in names})
    return out.drop(PART, *(f"_{n}" for n in names), *(f"_base_{n}" for n in names))


def bases(ready: DataFrame, totals: list, names: Sequence[str]) -> DataFrame:
    """(partition, _base_name): what the partitions before each one sum up to; as many rows as partitions, so it is broadcast."""
    rows, upto = [], [0] * len(names)
    for t in sorted(totals):
        rows.append((t[PART], *upto))
        upto = [u + t[n] for u, n in zip(upto, names, strict=True)]
    return F.broadcast(ready.sparkSession.createDataFrame(rows, f"{PART} int, " + ", ".join(f"_base_{n} long" for n in names)))


def with_halo(rows: DataFrame, order: Sequence[str], n: int) -> tuple[DataFrame, Column, list[str]]:
    """(rows, whether a row is at home, [partition, order]): every row, and in each range also the n - 1 rows that follow it.

    A window of n rows over partition and order that starts at home sees what one window over all rows would.
    """
    ready = dealt(rows, order)
    totals = sorted(ready.groupBy(PART).agg(F.count("*").alias("n")).collect())
    inside = Window.partitionBy(PART).orderBy(*order)
    ready = ready.withColumn("_at", F.row_number().over(inside) - 1).join(bases(ready, totals, ["n"]), PART)
    ready = ready.withColumn("_g", F.col("_at") + F.col("_base_n")).drop("_base_n")
    ends = list(accumulate(t["n"] for t in totals))
    known = F.array(*(F.struct(F.lit(t[PART]).alias("part"), F.lit(e).cast("long").alias("end")) for t, e in zip(totals, ends, strict=True)))
    if n > 1 and totals:
        earlier = F.filter(known, lambda k: (k["end"] <= F.col("_g")) & (k["end"] > F.col("_g") - (n - 1)))
        homes = F.when(F.col("_at") < n - 1, F.concat(F.array(F.col(PART)), F.transform(earlier, lambda k: k["part"]))).otherwise(F.array(F.col(PART)))
        ready = ready.withColumn("_to", F.explode(homes))
    else:
        ready = ready.withColumn("_to", F.col(PART))
    return ready.drop("_at"), F.col("_to") == F.col(PART), ["_to", "_g"]


def owners(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str = "position") -> DataFrame:
    """`points` with token_no and _owner_end of the span (token_no, start, end) that covers each; null between spans.

    Spans of one unit do not overlap, so one sweep over starts and points in order, carrying the last start, finds every owner: rows
    and work are those of both sides together.
    """
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    extra = [c for c in points.columns if c not in keys]
    opened = F.struct(F.col("token_no"), F.col("end")).alias("_open")
    left = spans.select(*keys, F.col("start").cast("long").alias("_pos"), F.lit(0).alias("_kind"), opened, *(none(c, points) for c in extra))
    kind = left.schema["_open"].dataType
    right = points.select(*keys, F.col(point).cast("long").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_open"), *extra)
    sweep = Window.partitionBy(*keys).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_open", F.last("_open", ignorenulls=True).over(sweep)).where("_kind = 1")
    covered = F.col("_open.end") > F.col("_pos")
    return met.select(*keys, *extra, F.when(covered, F.col("_open.token_no")).alias("token_no"), F.when(covered, F.col("_open.end")).alias("_owner_end"))

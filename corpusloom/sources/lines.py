"""Byte-exact, splittable line reader with a terminator set for each format.

Spark's text source cuts files at LF and nowhere else, in byte ranges of any size, and finds line starts across their borders; a CR before the LF stays with
its line, so no range can part the two.  What follows is per row, or a sum over one range: CRs are resolved inside a row, and numbers and
offsets are running sums within a range plus those of the ranges before it.  No file is one row, one task or one group.

A reader row is (path, line_no, content, ending, byte_start, byte_end, raw): content is null where the bytes are no UTF-8, and then
raw holds them; a byte order mark is part of the first line.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terminators by format: any of CRLF, LF, CR; or LF only, with a CR before it part of the ending.
ANY, LF_ONLY = "\r\n|\n|\r", "\r?\n"
BOM = "﻿"


def pieces_of(value: Column) -> Column:
    """The parts between CRs of a line; one that is no UTF-8 is cut byte by byte."""
    each = F.transform(F.split(F.decode(value.cast("binary"), "ISO-8859-1"), "\r", -1), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    return F.when(F.is_valid_utf8(value), F.split(value, "\r", -1)).otherwise(each)


def summed(rows: DataFrame) -> DataFrame:
    """`rows` with _b1 and _l1, the sums of _bytes and _lines over the rows before in the same range: one task reads a range in order, so nothing is shuffled."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, upto = None, (0, 0)
        for batch in filter(len, batches):
            path, block, own = batch.column(0), batch.column(1).to_numpy(), [batch.column(i).to_numpy() for i in (2, 3)]
            which = path.dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (block[1:] != block[:-1])) + 1)]
            out = [np.empty(len(block), np.int64) for _ in own]
            for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                here = (path[int(a)].as_py(), int(block[a]))
                upto, at = (upto if here == at else (0, 0)), here
                to = [u + np.cumsum(x[a:b]) for u, x in zip(upto, own, strict=True)]
                for o, t, x in zip(out, to, own, strict=True):
                    o[a:b] = t - x[a:b]
                upto = tuple(int(t[-1]) for t in to)
            yield pa.record_batch([*batch.columns, *(pa.array(o) for o in out)], names=[*batch.schema.names, "_b1", "_l1"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_b1", T.LongType()), T.StructField("_l1", T.LongType())]))


def read_lines(spark: SparkSession, path: str, terminators: str = ANY) -> DataFrame:
    """Lines of all files of `path`; an empty file has none, the last line may lack an ending.

    Ranges follow spark.sql.files.maxPartitionBytes and change nothing in the rows.  A file's size tells what its rows cannot: whether the
    last line has its LF, and whether the source has taken a byte order mark off.
    """
    found = spark.read.option("lineSep", "\n").text(path)
    found = found.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"))
    trailing = F.endswith("value", F.lit("\r"))
    crs = F.length(F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "[^\r]", "")) if terminators == ANY else F.lit(0)
    rows = found.withColumns({"_bytes": F.octet_length("value").cast("long") + 1, "_lines": (crs + 1 - F.when(trailing & F.lit(terminators == ANY), 1).otherwise(0)).cast("long")})
    by_path = Window.partitionBy("path").orderBy("_block")
    before = by_path.rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("path", "_block", "_size").agg(F.sum("_bytes").alias("_b"), F.sum("_lines").alias("_l"))  # a row a range
    every = Window.partitionBy("path")
    excess = F.col("_size") - F.sum("_b").over(every)  # 0, less one without a last LF, three more with a mark
    ranges = ranges.select(
        "path", "_block", F.col("_b"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_l0"),
        (F.col("_block") == F.max("_block").over(every)).alias("_last"), excess.isin(-1, 2).alias("_open"), (excess > 0).alias("_mark"),
    )
    rows = summed(rows.select("path", "_block", "_bytes", "_lines", F.col("value").cast("binary").alias("value"))).withColumn("value", F.col("value").cast("string"))
    rows = rows.join(F.broadcast(ranges), ["path", "_block"]).withColumn("_end", F.col("_b1") + F.col("_bytes") == F.col("_b"))
    cut = pieces_of(F.col("value")) if terminators == ANY else F.array(F.when(trailing, F.expr("substring(cast(value as binary), 1, octet_length(value) - 1)").cast("string")).otherwise(F.col("value")))
    rows = rows.withColumns({"_cut": cut, "_cr": trailing})
    if terminators == ANY:  # the part behind a trailing CR is no line of its own: the CR belongs to the LF
        rows = rows.withColumn("_cut", F.when(trailing, F.slice("_cut", F.lit(1), F.size("_cut") - 1)).otherwise(F.col("_cut")))
    lf = F.when(F.col("_last") & F.col("_end") & F.col("_open"), "").otherwise("\n")
    marked = F.col("_mark") & (F.col("_b0") + F.col("_b1") == 0)
    shift = F.when(F.col("_mark") & ~marked, F.lit(3)).otherwise(F.lit(0))
    start = F.col("_b0") + F.col("_b1") + shift
    size = lambda x: F.octet_length(x).cast("long")
    length = F.transform("_cut", lambda x: size(x) + 1)
    rows = rows.withColumns({"_start": start, "_mine": marked, "_lf": lf, "_ends": length})
    out = rows.select("path", "_l0", "_l1", "_start", "_mine", "_lf", "_cr", "_ends", "_lines", F.posexplode("_cut").alias("_i", "_x"))
    final = F.col("_i") == F.col("_lines") - 1
    ending = F.when(~final, "\r").otherwise(F.concat(F.when(F.col("_cr"), "\r").otherwise(""), "_lf"))
    offset = F.aggregate(F.slice("_ends", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.col("_mine") & (F.col("_i") == 0)
    begin = F.col("_start") + offset + F.when(F.col("_mine") & (F.col("_i") > 0), F.lit(3)).otherwise(F.lit(0))
    whole = F.when(first, F.concat(F.lit(BOM), "_x")).otherwise(F.col("_x"))
    out = out.withColumns({"line_no": F.col("_l0") + F.col("_l1") + F.col("_i") + 1, "_x": whole, "ending": ending, "byte_start": begin})
    valid = F.is_valid_utf8("_x")
    return out.select(
        "path", "line_no", F.when(valid, F.col("_x")).alias("content"), "ending", "byte_start", (F.col("byte_start") + size("_x") + F.octet_length("ending")).alias("byte_end"),
        F.when(~valid, F.col("_x").cast("binary")).alias("raw"),
    )


def rebuilt(lines: DataFrame) -> DataFrame:
    """(path, text, sha256): small files from their lines, as one value each, for reconstruction checks."""
    bytes_ = F.concat(F.coalesce(F.col("raw"), F.col("content").cast("binary")), F.col("ending").cast("binary"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("line_no", bytes_.alias("x")))), F.lit(b""), lambda a, t: F.concat(a, t["x"]))
    return lines.groupBy("path").agg(whole.alias("_all")).select("path", F.col("_all").cast("string").alias("text"), F.sha2("_all", 256).alias("sha256"))

"""Lossless text derivation as DataFrame functions: tokens, graphemes, code points, spans, ordinals.

Offsets are 0-based, half-open and in code points; token, grapheme and unit numbers start at 1.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of Python's str.isspace, as ranges.
WHITESPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """The inside of a character class that Java and RE2 read alike."""
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)


@cache
def category_ranges(prefix: str) -> tuple[tuple[int, int], ...]:
    """Ranges of all code points of a general category: pinned to Python's tables, as the JVM's differ."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)).startswith(prefix):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return tuple((a, b) for a, b in out)


WORD = f"[^{char_class(WHITESPACE_RANGES)}]+"
GAP = f"[{char_class(WHITESPACE_RANGES)}]+"


def surfaces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def token_structs(text: Column) -> Column:
    """array<struct<token_no, surface, delimiter_before, start, end>> of a text; null and blank texts give none."""
    words = surfaces(text)
    # every gap between words, and the one before the first, in order: splitting at words leaves exactly them
    gaps = F.split(text, WORD, -1)

    def add(acc: Column, i: Column) -> Column:
        word, gap = F.get(words, i), F.get(gaps, i)
        start = acc["at"] + F.length(gap)
        one = F.struct((i + 1).alias("token_no"), word.alias("surface"), gap.alias("delimiter_before"), start.alias("start"), (start + F.length(word)).alias("end"))
        return F.struct((start + F.length(word)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    kind = "array<struct<token_no:int,surface:string,delimiter_before:string,start:int,end:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), first, add, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


#: Rows of tokens in one Arrow batch: a batch of long texts holds millions.
TOKEN_ROWS = 1 << 15


def tokenize(units: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row a token: keys, token_no, surface, delimiter_before, start, end.

    Spans are known inside the unit's own row, so one Arrow pass finds them and nothing is shuffled or sorted.  Texts are taken one at a time and tokens
    given out TOKEN_ROWS at a time, so a worker's memory follows neither the number of texts nor the length of one.
    """
    import re

    import pyarrow as pa

    word = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in WHITESPACE_RANGES) + "]+")
    names = ("token_no", "surface", "delimiter_before", "start", "end")
    types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    limit = TOKEN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            out: tuple[list, ...] = ([], [], [], [], [])

            def made() -> pa.RecordBatch:
                take = pa.array(row, pa.int64())
                found = pa.record_batch([*(batch.column(i).take(take) for i in range(len(keys))), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*keys, *names])  # noqa: B023
                for c in (row, *out):  # noqa: B023
                    c.clear()
                return found

            for i, value in enumerate(batch.column(len(keys))):
                value = value.as_py() or ""
                at = 0
                for k, m in enumerate(word.finditer(value), 1):
                    row.append(i)
                    for column, x in zip(out, (k, m.group(), value[at : m.start()], m.start(), m.end()), strict=True):
                        column.append(x)
                    at = m.end()
                    if len(row) == limit:
                        yield made()
            if row:
                yield made()

    rows = units.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, kinds + "token_no int, surface string, delimiter_before string, start int, `end` int")


def reconstruct(tokens: DataFrame, *keys: str) -> DataFrame:
    """Text of each unit from its tokens (without the trailing delimiter)."""
    part = F.struct("token_no", F.concat("delimiter_before", "surface").alias("x"))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda t: t["x"]), "").alias("text"))


def graphemes(units: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Extended grapheme clusters: grapheme_no, value, start, end."""
    rows = units.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(\X)"), 1)).alias("_i", "value"))
    run = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("value")).over(run).cast("int")
    return rows.withColumns({"end": end}).select(*keys, (F.col("_i") + 1).alias("grapheme_no"), "value", (F.col("end") - F.length("value")).alias("start"), "end")


def codepoints(units: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row a code point: position (from 0), character, codepoint (U+XXXX)."""
    rows = units.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(F.col(text), "")).alias("position", "character"))
    return rows.where("character <> ''").withColumn("codepoint", F.format_string("U+%04X", F.ascii("character")))


def unicode_dimension(spark: SparkSession, characters: DataFrame) -> DataFrame:
    """(character, name, category, combining, flags) of the distinct characters of `characters`: at most Unicode's size."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            c = p["character"]
            category = c.map(unicodedata.category)
            yield pd.DataFrame({
                "character": c, "name": c.map(lambda x: unicodedata.name(x, None)), "category": category, "combining": c.map(unicodedata.combining),
                "is_combining": category.str.startswith("M"), "is_whitespace": c.map(str.isspace), "is_punctuation": category.str.startswith("P"),
                "is_annotation": c.map(lambda x: 0x06D6 <= ord(x) <= 0x06ED),
            })

    schema = "character string, name string, category string, combining int, is_combining boolean, is_whitespace boolean, is_punctuation boolean, is_annotation boolean"
    return characters.select("character").distinct().mapInPandas(run, schema)


def codepoint_inventory(units: DataFrame, text: str = "text") -> DataFrame:
    """(codepoint, character, n): each task counts its texts in one array of Unicode's size, so no row a character is made."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sys.maxunicode + 1, np.int64)
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if t:
                    held.append(t.encode("utf-32-le"))
                    size += len(held[-1])
                if size > 1 << 24:
                    counts += np.bincount(np.frombuffer(b"".join(held), "<u4"), minlength=len(counts))
                    held, size = [], 0
        counts += np.bincount(np.frombuffer(b"".join(held), "<u4"), minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([f"U+{c:04X}" for c in met], pa.string()), pa.array([chr(c) for c in met], pa.string()), pa.array(counts[met])], ["codepoint", "character", "n"])

    found = units.select(F.col(text).cast("string")).mapInArrow(run, "codepoint string, character string, n long")
    return found.groupBy("codepoint", "character").agg(F.sum("n").alias("n"))

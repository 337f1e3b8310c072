"""Reader of collection|unit|text corpora, with diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import read_lines

#: Words that mark footer lines; licence words are tried first.
LICENSE_WORDS = ("copyright", "license", "terms of use", "permission is granted", "changing it is not allowed", "copyright notice", "verbatim copies", "derived from", "website or application", "reproduced appropriately")
METADATA_WORDS = ("tanzil quran text", "tanzil project", "tanzil.net", "verified", "specialists", "updates", "this copy of the quran text")
#: Format names that share the reader.
FORMATS = ("pipe-ayah-v1", "tanzil-text-with-ayah-numbers-v1")


def line_class(content: Column) -> Column:
    """Class of a line that is no unit."""
    low = F.lower(content)
    has = lambda words: F.lit(False) if not words else _any(low, words)
    return F.when(content == "", "blank").when(~content.startswith("#"), "unknown").when(has(LICENSE_WORDS), "license").when(has(METADATA_WORDS), "source_metadata").otherwise("comment")


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def decimal_digits() -> tuple[str, str]:
    """Every decimal digit of Unicode, and the ASCII digit each stands for."""
    found = [c for c in map(chr, range(0x110000)) if c.isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


DIGITS, PLAIN = decimal_digits()
NUMBER = f"^[{DIGITS}]+$"


def positive(value: Column) -> Column:
    """A positive whole number in decimal digits of any script, else null."""
    number = F.translate(value, DIGITS, PLAIN).try_cast("long")
    return F.when(value.rlike(NUMBER) & (number > 0), number)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds record_type, collection_no, unit_no and text.  Text may hold further pipes; lines with a pipe and no address, and lines that are no UTF-8, are malformed."""
    parts = F.split("content", "\\|", 3)
    first, second = positive(F.get(parts, F.lit(0))), positive(F.get(parts, F.lit(1)))
    shaped = F.size(parts) == 3
    unit = shaped & first.isNotNull() & second.isNotNull()
    piped = (F.size(parts) >= 2) & ~F.col("content").startswith("#")
    kind = F.when(F.col("content").isNull(), "malformed").when(unit, "unit_record").when(piped, "malformed").otherwise(line_class(F.col("content")))
    return lines.withColumns({
        "record_type": kind, "collection_no": F.when(unit, first), "unit_no": F.when(unit, second), "text": F.when(unit, F.get(parts, F.lit(2))),
    })


def read_corpus(spark: SparkSession, path: str, fmt: str = FORMATS[0]) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported source format: {fmt}")
    return parse_lines(read_lines(spark, path))


def units(parsed: DataFrame) -> DataFrame:
    """(path, collection_no, unit_no, text, line_no, source_order)."""
    rows = parsed.where("record_type = 'unit_record'")
    order = Window.partitionBy("path").orderBy("line_no")
    return rows.select("path", "collection_no", "unit_no", "text", "line_no", F.row_number().over(order).alias("source_order"))


def duplicates(rows: DataFrame, *address: str, order: str = "line_no") -> DataFrame:
    """Addresses met more than once: first line and number of further ones."""
    return rows.groupBy(*address).agg(F.min(order).alias("first"), (F.count("*") - 1).alias("further")).where("further > 0")


def gaps(rows: DataFrame, collection: str, unit: str) -> DataFrame:
    """(collection, missing): unit numbers that a collection lacks between its first and its last one.

    Only the holes between neighbours are made, so no row holds a collection's numbers.
    """
    have = rows.where(F.col(unit) >= 1).select(collection, unit).distinct()
    before = F.lag(unit).over(Window.partitionBy(collection).orderBy(unit))
    holes = have.withColumn("_before", before).where(F.col(unit) - F.col("_before") > 1)
    return holes.select(collection, F.explode(F.sequence(F.col("_before") + 1, F.col(unit) - 1)).alias("missing"))


def collection_gaps(rows: DataFrame, collection: str) -> list[int]:
    """Collection numbers missing between the first and the last one, from one row a collection."""
    have = sorted(r[0] for r in rows.select(collection).distinct().collect())
    return [n for a, b in zip(have, have[1:], strict=False) for n in range(a + 1, b)]


def reversals(rows: DataFrame, collection: str, order: str, path: str = "path") -> DataFrame:
    """Rows whose collection number is below the one before."""
    before = F.lag(collection).over(Window.partitionBy(path).orderBy(order))
    return rows.withColumn("before", before).where(F.col(collection) < F.col("before"))


def diagnostics(parsed: DataFrame) -> dict[str, object]:
    """Bounded counts; gaps and reversals do not make a source fail."""
    kinds = {r[0]: r[1] for r in parsed.groupBy("record_type").count().collect()}
    endings = {r[0]: r[1] for r in parsed.groupBy("ending").count().collect()}
    rows = units(parsed)
    empty = rows.where("text = ''").count()
    twice = duplicates(rows, "path", "collection_no", "unit_no").count()
    ends = rows.agg(F.min(F.struct("line_no", "collection_no", "unit_no")).alias("first"), F.max(F.struct("line_no", "collection_no", "unit_no")).alias("last")).first()
    address = lambda r: [r["collection_no"], r["unit_no"]] if r else None
    failed = bool(kinds.get("malformed") or kinds.get("unknown") or empty or twice)
    return {"classes": kinds, "newlines": endings, "empty_text": empty, "duplicates": twice, "gaps": gaps(rows, "collection_no", "unit_no").count(), "reversals": reversals(rows, "collection_no", "line_no").count(), "collection_gaps": collection_gaps(rows, "collection_no"), "first": address(ends["first"]), "last": address(ends["last"]), "failed": failed}

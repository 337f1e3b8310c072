"""What a source and its parsed records must satisfy.

A source's metadata is a small mapping that is checked on the driver.  Records are checked where they are: a fault is a row, and
only `faithful` gathers the lines of a file.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..provenance import canonical_hash

#: Classes of sources, and what may become of a record.
SOURCE_CLASSES = ("synthetic-fixture", "user-local-dataset")
STATUSES = ("parsed", "unknown", "malformed")
ENDINGS = ("", "\n", "\r\n", "\r")
#: Fixed value: how a parser configuration is hashed.
CONFIGURATION_HASH = "sha256-canonical-json-v1"

#: Text fields that a source's metadata must fill, by part.
FILLED = {
    "identity": ("source_identifier", "adapter_identifier", "adapter_version"), "acquisition": ("local_filename", "original_filename"),
    "parser_configuration": ("parser_identifier", "parser_version"),
}
DIGESTS = {"sha256": 64, "sha512": 128}


def metadata_faults(metadata: Mapping[str, Any]) -> list[str]:
    """Everything that is wrong with a source's metadata; nothing, if it is sound.

    Parts: identity, acquisition, parser_configuration and integrity with its fingerprint; a sha512 is optional.
    """
    part = lambda name: metadata.get(name) or {}
    found = [f"{p}.{f} is empty" for p, names in FILLED.items() for f in names if not part(p).get(f)]
    if part("identity").get("source_class") not in SOURCE_CLASSES:
        found.append(f"identity.source_class is one of {', '.join(SOURCE_CLASSES)}")
    try:
        date.fromisoformat(str(part("acquisition").get("acquisition_date")))
    except ValueError:
        found.append("acquisition.acquisition_date is a date")
    prints = part("integrity").get("fingerprint") or {}
    for name, digits in DIGESTS.items():
        value = prints.get(name)
        if (value is not None or name == "sha256") and (len(str(value)) != digits or set(str(value)) - set("0123456789abcdef")):
            found.append(f"fingerprint.{name} is {digits} lowercase hexadecimal digits")
    count = prints.get("byte_count")
    if not isinstance(count, int) or count < 0:
        found.append("fingerprint.byte_count is a whole number of at least 0")
    return found


def metadata_hash(metadata: Mapping[str, Any]) -> str:
    """Digest of sound metadata."""
    if found := metadata_faults(metadata):
        raise ValueError("; ".join(found))
    return canonical_hash(metadata)


def configuration_hash(parser: str, version: str, options: Mapping[str, Any] | None = None) -> dict[str, str]:
    """The order of options changes nothing."""
    if not parser or not version:
        raise ValueError("a parser has a name and a version")
    return {"algorithm": CONFIGURATION_HASH, "digest": canonical_hash({"parser_identifier": parser, "parser_version": version, "options": dict(options or {})})}


def _has(records: DataFrame, column: str) -> Column:
    return F.col(column).isNotNull() if column in records.columns else F.lit(False)


def record_faults(records: DataFrame) -> DataFrame:
    """(path, line_no, fault) for records of a reader; a sound file has none, a record may have several.

    A null status or ending is a fault.  A locator or features on a record that was not parsed count as a parsed view of it.
    """
    status, parsed = F.col("parse_status"), F.col("parse_status") == "parsed"
    below = F.lit(False)
    if "address" in records.columns:
        parts = [f.name for f in records.schema["address"].dataType.fields]
        below = reduce(lambda a, b: a | b, (F.coalesce(F.col("address")[p] < 1, F.lit(False)) for p in parts))
    octets = F.octet_length(F.concat("content", "ending"))
    tests = {
        "line_no starts at 1": ~(F.col("line_no") >= 1), "content holds its ending": F.col("content").rlike(r"[\r\n]\z"), "unknown ending": ~F.col("ending").isin(*ENDINGS) | F.col("ending").isNull(),
        "unknown status": ~status.isin(*STATUSES) | status.isNull(), "parsed without a locator": parsed & ~_has(records, "locator"), "parsed view without parsed status": ~parsed & _has(records, "locator"),
        "malformed without an error": (status == "malformed") & ~_has(records, "parse_error"), "error on a record that is not malformed": (status != "malformed") & _has(records, "parse_error"),
        "locator parts start at 1": below, "bytes do not span the line": octets != F.col("byte_end") - F.col("byte_start"),
    }
    if "parse_error" not in records.columns:  # this layout tells no errors
        tests = {k: v for k, v in tests.items() if "error" not in k}
    found = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    return records.select("path", "line_no", F.explode(found).alias("fault"))


def file_faults(records: DataFrame) -> DataFrame:
    """(path, fault): lines that are not numbered 1, 2, ..., or bytes that leave gaps or overlap; one aggregate, no ordering.

    Distinct numbers from 1 to their count are consecutive.  Spans tile the file if every end but the last is a start, once.
    """
    ends = records.select("path", F.col("byte_end").alias("at"), F.lit(1).alias("n")).union(records.select("path", F.col("byte_start"), F.lit(-1)))
    seams = ends.groupBy("path", "at").agg(F.sum("n").alias("n")).groupBy("path").agg(F.sum(F.abs("n")).alias("open"))
    lines = records.groupBy("path").agg(
        F.count("*").alias("n"), F.count_distinct("line_no").alias("d"), F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.min("byte_start").alias("from"),
    )
    numbered = (F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    tiled = (F.col("open") == 2) & (F.col("from") == 0)
    found = F.array_compact(F.array(F.when(~numbered, F.lit("lines are not consecutive from 1")), F.when(~tiled, F.lit("bytes have gaps or overlaps"))))
    return lines.join(seams, "path").select("path", F.explode(found).alias("fault"))


def faithful(records: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(path, faithful): whether the records of each file of `fingerprints` rebuild its bytes; an empty file has no records and is faithful.

    One file is one value here, as in the reader.  Spark reads no empty files, so `annotations.fingerprint` has no row for them.
    """
    from .lines import rebuilt

    met = fingerprints.select("path", "bytes", F.col("sha256").alias("_own")).join(rebuilt(records), "path", "left")
    return met.select("path", F.coalesce(F.col("sha256") == F.col("_own"), F.col("bytes") == 0).alias("faithful"))

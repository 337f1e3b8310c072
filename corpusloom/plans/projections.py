"""Result shapes over evidence rows, and the exact morphology filter."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import METHODS
from .binding import base

#: Filters of a morphology query: field and column.
FILTERS = {
    "collection": "collection_no", "unit": "unit_no", "token": "token_no", "segment": "segment_index", "root": "root", "lemma": "lemma", "pos": "pos", "method": "method",
    "release": "release_id",
}
NUMBERS = ("collection", "unit", "token", "segment", "release")


@dataclass(frozen=True)
class MorphologyFilter:
    """Equal values of columns, and one feature; nothing set filters nothing."""

    collection: int | None = None
    unit: int | None = None
    token: int | None = None
    segment: int | None = None
    root: str | None = None
    lemma: str | None = None
    pos: str | None = None
    method: str | None = None
    release: int | None = None
    feature: str | None = None

    def __post_init__(self) -> None:
        for f in NUMBERS:
            v = getattr(self, f)
            if v is not None and (not isinstance(v, int) or v < 1):
                raise ValueError(f"{f} is a whole number of at least 1")
        if self.method is not None and self.method not in METHODS:
            raise ValueError(f"unknown alignment method: {self.method}")

    def given(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(MorphologyFilter) if getattr(self, f.name) is not None}

    def apply(self, evidence: DataFrame) -> DataFrame:
        """Matched rows of completed runs that pass; a feature is one of the row's fragments."""
        given = self.given()
        tests = [F.col(FILTERS[k]) == v for k, v in given.items() if k != "feature"]
        if "feature" in given:
            tests.append(F.coalesce(F.array_contains("features", given["feature"]), F.lit(False)))
        return base(evidence).where(reduce(lambda a, b: a & b, tests, F.lit(True)))


@dataclass(frozen=True)
class MorphologyQuery(MorphologyFilter):
    """A filter of at least one field, with a page of 1 to 500 rows."""

    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.given():
            raise ValueError("a morphology query needs a filter")
        if not 1 <= self.limit <= 500 or self.offset < 0:
            raise ValueError("limit must be 1..500 and offset nonnegative")

    def page(self, evidence: DataFrame) -> DataFrame:
        """Occurrences in order of place, ties by alignment_id, so that pages are stable."""
        order = [F.asc_nulls_last(c) for c in ("collection_no", "unit_no", "token_no", "segment_index", "source_line", "alignment_id")]
        return occurrences(self.apply(evidence).orderBy(*order).offset(self.offset).limit(self.limit))


#: Columns of an occurrence.
OCCURRENCE = (
    "alignment_id", "release_id", "method", "status", "confidence", "record_id", "analysis_id", "segment_id", "segment_index", "form", "pos", "root", "lemma", "features", "parse_status",
    "source_line", "token_id", "surface", "token_no", "collection_no", "unit_no", "unit_text",
)


def occurrences(rows: DataFrame) -> DataFrame:
    return rows.select(*OCCURRENCE)


def evidence_struct():
    """Where a row comes from: stable names, places and ids of each layer."""
    return F.struct(
        F.concat_ws(":", "collection_no", "unit_no", "token_no").alias("canonical_id"), F.struct("collection_no", "unit_no", "token_no", "token_id", "unit_id").alias("canonical"),
        F.struct("analysis_id", "segment_id", "segment_index").alias("annotation"), F.struct("record_id", "source_line", "parse_status", "features").alias("source_native"),
        F.struct("alignment_id", "method", "status", "confidence").alias("alignment"), F.col("release_id").alias("source_release"),
    )


def research_matches(rows: DataFrame) -> DataFrame:
    """Coordinate, texts and annotation of each row, with its evidence and release as structs."""
    return rows.select(
        F.struct("collection_no", "unit_no", "token_no", "segment_index").alias("coordinate"), F.col("unit_text").alias("text"), F.col("surface").alias("token"), F.col("form").alias("segment"),
        "root", "lemma", "pos", "features", evidence_struct().alias("evidence"), F.struct("release_id").alias("release"),
    )


def token_results(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each token hit: its address, text, span and unit."""
    return tokens.join(units, "unit_id").select(
        "token_id", "unit_id", "collection_no", "unit_no", "token_no", "surface", "start", "end", F.length("surface").alias("length"), F.concat_ws(":", "collection_no", "unit_no", "token_no").alias("address"), "unit_text",
    )


def row_by_id(rows: DataFrame, column: str, value: object) -> DataFrame:
    return rows.where(F.col(column) == value)


def preview(rows: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    """A page of any table in a given order."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset nonnegative")
    return rows.orderBy(*(F.asc_nulls_last(c) for c in order)).offset(offset).limit(limit)


def token_page(tokens: DataFrame, units: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    """A page of `token_results` in an order of tokens' columns, where every token has its unit: cut first, so that only the page's rows meet texts."""
    page = preview(tokens, limit, offset, *order)
    return token_results(F.broadcast(page), units).orderBy(*(F.asc_nulls_last(c) for c in order))

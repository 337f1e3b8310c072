"""Frequency and distribution statistics over an evidence table; counts name what they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binding import base


def summary(evidence: DataFrame) -> DataFrame:
    place = F.when(F.col("unit_id").isNotNull(), F.struct("collection_no", "unit_no"))
    return base(evidence).agg(
        F.count_distinct("segment_id").alias("segments"), F.count_distinct("token_id").alias("tokens"), F.count_distinct(place).alias("units"),
        F.count_distinct("record_id").alias("records"), F.count("*").alias("rows"),
    )


def frequency(evidence: DataFrame, value: Column | str, drop_null: bool = False) -> DataFrame:
    rows = base(evidence).withColumn("value", F.col(value) if isinstance(value, str) else value)
    return (rows.where("value is not null") if drop_null else rows).groupBy("value").agg(F.count_distinct("segment_id").alias("n"))


def roots(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "root", True)


def lemmas(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "lemma", True)


def tags(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "pos")


def features(evidence: DataFrame) -> DataFrame:
    """explode, not explode_outer: rows without features count nowhere."""
    rows = base(evidence).select("segment_id", F.explode("features").alias("value"))
    return rows.groupBy("value").agg(F.count_distinct("segment_id").alias("n"))


def releases(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "release_id")


def parser_statuses(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "parse_status")


def methods(evidence: DataFrame) -> DataFrame:
    return frequency(evidence, "method")


def collections(evidence: DataFrame) -> DataFrame:
    return base(evidence).groupBy("collection_no").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("token_id").alias("tokens"), F.count_distinct("unit_id").alias("units"))


def units(evidence: DataFrame) -> DataFrame:
    return base(evidence).groupBy("collection_no", "unit_no").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("token_id").alias("tokens"))


def segment_distribution(evidence: DataFrame) -> DataFrame:
    """How many tokens have 1, 2, ... segments."""
    own = base(evidence).where("token_id is not null").groupBy("token_id").agg(F.count_distinct("segment_id").alias("segments"))
    return own.groupBy("segments").agg(F.count("*").alias("tokens"))


parser_status_distribution, source_release_distribution, alignment_method_distribution = parser_statuses, releases, methods


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table: one plan, counts only."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """count descending, value ascending with nulls last; 1 to 500 rows."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset nonnegative")
    return rows.orderBy(F.desc("n"), F.asc_nulls_last("value")).offset(offset).limit(limit)

"""Alignment of annotation segments to tokens by address, keeping ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize, remove_marks
from ..scratch import written

METHODS = ("DIRECT", "NORMALIZED", "AMBIGUOUS", "UNMATCHED")
ADDRESS = ["collection_no", "unit_no", "token_no"]


def align(segments: DataFrame, tokens: DataFrame, profile: str = "base_arabic_letters_v1") -> DataFrame:
    """One row for each (segment, candidate); segments without a candidate keep one row.

    segments: segment_id, address, form; tokens: token_id, address, surface.  Several candidates are all kept as
    AMBIGUOUS: none is chosen.
    """
    met = segments.join(tokens.select(*ADDRESS, "token_id", "surface").hint("merge"), ADDRESS, "left")
    n = F.count("token_id").over(Window.partitionBy("segment_id"))
    left, right = normalize(F.col("form"), profile), normalize(F.col("surface"), profile)
    same = (F.col("form") != F.col("surface")) & (left != "") & (left == right)
    method = F.when(F.col("_n") == 0, "UNMATCHED").when(F.col("_n") > 1, "AMBIGUOUS").when(same, "NORMALIZED").otherwise("DIRECT")
    out = met.withColumn("_n", n).withColumn("method", method)
    confidence = F.when(F.col("method") == "DIRECT", 1.0).when(F.col("method") == "NORMALIZED", 0.95).otherwise(0.0)
    return out.withColumns({"confidence": confidence, "status": F.lower("method"), "is_ambiguous": F.col("method") == "AMBIGUOUS"}).drop("_n")


#: Rules of the staged alignment, each with its status for a whole token, its status for a segment, and its confidence; of several
#: bounded candidates none is chosen, with status ambiguous and confidence 0.
RULES = {
    "invalid_locator": ("unaligned", "unaligned", 0.0),
    "missing_locator": ("unaligned", "unaligned", 0.0),
    "exact_token": ("aligned", "aligned", 1.0),
    "segment_exact": ("aligned", "aligned", 1.0),
    "normalized_token": ("aligned", "partial", 0.9),
    "bounded_candidate": ("partial", "partial", 0.6),
    "surface_mismatch": ("unaligned", "unaligned", 0.0),
}


def align_staged(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """The staged rules: a token at the address, then equality with or without marks, then candidates in the same unit; ambiguous ones keep no token.

    segments: segment_id, collection_no, unit_no, token_no (null where the locator is invalid), segment_no, form.  An address without a token
    ends the search: nothing elsewhere is tried.  Adds rule, status, confidence and token_id.  Tables made by exploding texts look small to the
    optimizer; as they are not, they are merged, never sent to all.
    """
    at = segments.join(tokens.select(*ADDRESS, F.col("token_id").alias("_at"), F.col("surface").alias("_surface")).hint("merge"), ADDRESS, "left")
    key = remove_marks(F.col("form"))
    at = at.withColumns({"_key": key, "_same": F.col("_surface") == F.col("form"), "_like": remove_marks(F.col("_surface")) == key}).drop("_surface")  # the surface goes no further
    others = tokens.select("collection_no", "unit_no", remove_marks(F.col("surface")).alias("_key"), F.col("token_id").alias("_other"))
    others = others.groupBy("collection_no", "unit_no", "_key").agg(F.count("*").alias("_count"), F.min("_other").alias("_one"))
    met = at.join(others.hint("merge"), ["collection_no", "unit_no", "_key"], "left")
    part = F.col("segment_no").isNotNull()
    invalid = F.col("collection_no").isNull() | F.col("unit_no").isNull() | F.col("token_no").isNull()
    rule = (
        F.when(invalid, "invalid_locator").when(F.col("_at").isNull(), "missing_locator")
        .when(F.col("_same"), F.when(part, "segment_exact").otherwise("exact_token"))
        .when(F.col("_like"), "normalized_token")
        .when(F.col("_count") >= 1, "bounded_candidate").otherwise("surface_mismatch")
    )
    out = met.withColumn("rule", rule)
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for r, told in RULES.items() for x in (r, told[i]))), F.col("rule"))
    own = F.col("rule").isin("exact_token", "segment_exact", "normalized_token")
    several = (F.col("rule") == "bounded_candidate") & (F.col("_count") > 1)
    token = F.when(own, F.col("_at")).when((F.col("rule") == "bounded_candidate") & ~several, F.col("_one"))
    status = F.when(several, "ambiguous").when(part, of(1)).otherwise(of(0))
    return out.withColumns({"status": status, "confidence": F.when(several, 0.0).otherwise(of(2)), "token_id": token}).drop("_at", "_same", "_like", "_key", "_count", "_one")


def statistics(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("segment_id").alias("segments"))


def check_partition(aligned: DataFrame, total: int) -> None:
    """Every segment has a row, and rows are at least as many as segments."""
    got = aligned.agg(F.count_distinct("segment_id").alias("s"), F.count("*").alias("n")).first()
    if got["s"] != total or got["n"] < total:
        raise RuntimeError(f"alignment covers {got['s']} of {total} segments")


def conflicts(analyses: DataFrame, key: str = "token_id", dimensions: tuple[str, ...] = ("lemma", "root", "pos")) -> DataFrame:
    """(key, dimensions): tokens with more than one nonempty value, and where."""
    some = analyses.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.count_distinct(F.nullif(F.col(d), F.lit(""))).alias(d) for d in dimensions))
    found = F.array_compact(F.array(*(F.when(F.col(d) > 1, F.lit(d)) for d in dimensions)))
    return some.select(key, found.alias("dimensions")).where(F.size("dimensions") > 0)


def with_conflicts(aligned: DataFrame, analyses: DataFrame) -> DataFrame:
    """`aligned` with status `conflict` where its token has conflicting analyses, and conflict_dimensions (empty elsewhere)."""
    met = aligned.join(conflicts(analyses), "token_id", "left")
    found = F.coalesce("dimensions", F.array().cast("array<string>"))
    return met.withColumns({"status": F.when(F.size(found) > 0, "conflict").otherwise(F.col("status")), "conflict_dimensions": found}).drop("dimensions")


def conflicting(aligned: DataFrame, dimension: str | None = None) -> DataFrame:
    """Rows in conflict, about one dimension if it is named."""
    rows = aligned.where(F.col("status") == "conflict")
    return rows if dimension is None else rows.where(F.array_contains("conflict_dimensions", dimension))


def in_conflict(aligned: DataFrame, analyses: DataFrame, dimension: str | None = None) -> DataFrame:
    """`conflicting(with_conflicts(aligned, analyses), dimension)`, joined to tokens in conflict only.

    These are written before they are joined, so where they are few, rows of `aligned` are not shuffled, and nothing is built at the driver that
    files do not show to be small.
    """
    found = conflicts(analyses)
    found = written(found if dimension is None else found.where(F.array_contains("dimensions", dimension)), "conflicts")
    return aligned.join(found, "token_id").withColumn("status", F.lit("conflict")).withColumnRenamed("dimensions", "conflict_dimensions")


def at_locator(aligned: DataFrame, collection_no: int, unit_no: int, token_no: int) -> DataFrame:
    return aligned.where((F.col("collection_no") == collection_no) & (F.col("unit_no") == unit_no) & (F.col("token_no") == token_no))


def validation_counts(records: DataFrame, analyses: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: parsed records, analyses, aligned rows, and whether each parsed record has an analysis and each analysis a row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(records.where("parse_status = 'parsed'"), "parsed").join(n(analyses, "analyses")).join(n(aligned, "alignments"))  # one row each
    return one.withColumn("valid", (F.col("parsed") == F.col("analyses")) & (F.col("analyses") <= F.col("alignments")))


def unaligned_only(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments that an earlier run has not aligned: aligning these and appending makes a repeated run add nothing."""
    return segments.join(done.select("segment_id").distinct(), "segment_id", "left_anti")


def unresolved(staged: DataFrame, status: str) -> DataFrame:
    return staged.where(F.col("status") == status)

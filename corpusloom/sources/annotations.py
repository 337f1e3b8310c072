"""Readers of the two annotation layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import feature_struct, locator, resolved, synthetic_features
from .lines import ANY, LF_ONLY, read_lines

HEADER = "LOCATION\tFORM\tTAG\tFEATURES"


def parse_v04(lines: DataFrame) -> DataFrame:
    """Four tab fields with a locator (a:b:c:d): kind, parse_status, parse_error, locator, form, tag, features, root, lemma."""
    c = F.col("content")
    fields = F.split(c, "\t", -1)
    four = F.size(fields) == 4
    place = F.regexp_extract(c, r"^\(([1-9][0-9]*:[1-9][0-9]*:[1-9][0-9]*:[1-9][0-9]*)\)\t", 1)
    good = four & (place != "")
    other = F.when(c == "", "blank").when(c == HEADER, "header").when(c.startswith("#") & F.lower(c).contains("copyright"), "copyright").when(c.startswith("#"), "comment")
    tried = c.startswith("(") | (c.contains("\t") & other.isNull())
    tried, broken = F.coalesce(tried, F.lit(False)), c.isNull()
    good = F.coalesce(good, F.lit(False))
    kind = F.when(broken, "unknown").when(other.isNotNull(), other).when(tried, "morphology").otherwise("unknown")
    status = F.when(broken, "malformed").when(other.isNotNull() | ~tried, "unknown").when(good, "parsed").otherwise("malformed")
    error = F.when(status == "malformed", F.when(broken, "no UTF-8").when(four, "invalid locator").otherwise("exactly four tab-separated fields"))
    get = lambda i: F.when(good, F.get(fields, F.lit(i)))
    features = F.when(good, feature_struct(F.get(fields, F.lit(3))))
    out = lines.withColumns({"kind": kind, "parse_status": status, "parse_error": error, "locator": F.when(good, place), "form": get(1), "tag": get(2), "features": features})
    none = F.lit(None).cast("string")
    return out.withColumns({"address": locator(F.col("locator")), "root": resolved(none, F.col("features.native"), "ROOT"), "lemma": resolved(none, F.col("features.native"), "LEM")})


def parse_synthetic(lines: DataFrame) -> DataFrame:
    """Eight tab fields: locator, surface, transliteration, pos, lemma, root, features, variant."""
    c, fields = F.col("content"), F.col("_fields")
    eight = F.size(fields) == 8
    kind = F.when(c.isNull(), "malformed").when(c == "", "blank").when(c.startswith("#") & F.lower(c).contains("license"), "license").when(c.startswith("#"), "comment").when(c.startswith("@"), "unknown").when(eight, "analysis").otherwise("malformed")
    cut = lines.select("*", F.explode(F.array(F.struct(F.split(c, "\t", -1).alias("f")))).alias("_x")).withColumn("_fields", F.col("_x.f"))  # cut once a row
    told = cut.select("*", F.explode(F.array(kind)).alias("kind"))
    kind = F.col("kind")
    status = F.when(kind == "analysis", "parsed").when(kind == "malformed", "malformed").otherwise("unknown")
    get = lambda i: F.when(kind == "analysis", F.get(fields, F.lit(i)))
    filled = lambda i: F.nullif(get(i), F.lit(""))
    return told.withColumns({
        "parse_status": status, "locator": get(0), "form": get(1), "transliteration": get(2), "pos": filled(3), "lemma": filled(4), "root": filled(5),
        "features": synthetic_features(get(6)), "variant": F.coalesce(filled(7).try_cast("int"), F.when(kind == "analysis", 1)), "address": locator(get(0)),
    }).drop("_x", "_fields")


def read_v04(spark: SparkSession, path: str) -> DataFrame:
    return parse_v04(read_lines(spark, path, LF_ONLY))


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    return parse_synthetic(read_lines(spark, path, ANY))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, sha512) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("parse_status").agg(F.count("*").alias("n"))

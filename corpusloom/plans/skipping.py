"""Which files of a written evidence table can hold what a request asks for.

The index has a row for each file and each root, lemma, feature and profile in it, sorted by these, so looking values up reads few of its row groups.
A request's conjunctive predicates on them leave only files that hold a value of each; the evidence is then read from those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ast import Boolean, Expression, Predicate, Query

#: Indexed dimensions and their columns; arrays are indexed by element.
INDEXED = {"root": "root", "lemma": "lemma", "feature": "features", "normalization_profile": "profiles"}


def write_index(evidence: DataFrame, path: str) -> None:
    """(dimension, value, file) of the evidence, a row for each value of a file; distinct by partial aggregates."""
    file = F.col("_metadata.file_path").alias("file")

    def part(dimension: str, column: str) -> DataFrame:
        value = F.explode(column) if evidence.schema[column].dataType.typeName() == "array" else F.col(column)
        return evidence.select(F.lit(dimension).alias("dimension"), value.alias("value"), file)

    every = reduce(DataFrame.unionByName, (part(d, c) for d, c in INDEXED.items())).where("value is not null").distinct()
    every.repartitionByRange("dimension", "value").sortWithinPartitions("dimension", "value").write.parquet(path)


def demanded(e: Expression) -> list[tuple[str, tuple[str, ...]]]:
    """(dimension, values) of the predicates that every row of the answer must meet: those not under or and not."""
    if isinstance(e, Predicate):
        values = e.value if isinstance(e.value, tuple) else (e.value,)
        return [(e.dimension, tuple(map(str, values)))] if e.dimension in INDEXED and e.operator in ("eq", "in") else []
    assert isinstance(e, Boolean)
    return [x for c in e.children for x in demanded(c)] if e.operator == "and" else []


def files(index: DataFrame, query: Query) -> list[str] | None:
    """Files that may hold rows of the answer, at most as many as the evidence has; None: the index cannot tell."""
    asked = demanded(query.canonical().where)
    if not asked:
        return None
    one = [(F.col("dimension") == d) & F.col("value").isin(list(v)) for d, v in asked]
    which = F.array_compact(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(one))))
    met = index.where(reduce(lambda a, b: a | b, one)).select("file", F.explode(which).alias("i")).groupBy("file").agg(F.count_distinct("i").alias("n"))
    return sorted(r["file"] for r in met.where(F.col("n") == len(asked)).select("file").collect())


def evidence_for(spark: SparkSession, path: str, index: DataFrame, query: Query) -> DataFrame:
    """The evidence table at `path` for one request: only the files that its predicates leave."""
    whole = spark.read.parquet(path)
    found = files(index, query)
    if found is None:
        return whole
    return spark.read.option("basePath", path).schema(whole.schema).parquet(*found) if found else whole.limit(0)

"""Operator 7: mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of a source gets a Poisson number of copies whose mean is the source's repetition rate, so the
expected size of each source is its weight of the whole.  The count is the inverse of the Poisson distribution at a
uniform number that the document's key and a seed fix, so a task that runs again draws the same copies.

Each source's distribution is tabulated once; a document finds its count in it by bisection.  The table of sources is written before
it meets the documents: Spark knows its size, broadcasts it only below its limit, and otherwise splits a source that
holds a third of all rows like any skewed key.  Copies, whole documents, are dealt out by a hash of their columns and
number, so that neither null nor repeated keys gather in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: A rate's table starts at 0 up to this rate; beyond it exp(-rate) nears underflow, and the table starts 12 deviations below the rate.
FROM_ZERO = 700.0
#: Copies that one array holds.
AT_ONCE = 1 << 16
#: Columns that `mix` adds; others of these names in its input give way.
ADDED = ("copy", "mix_key")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key: 52 bits of an MD5 digest; null reads as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def first_count(rate: Column) -> Column:
    """The count that a rate's table starts with."""
    return F.when(rate > FROM_ZERO, F.floor(rate - F.sqrt(rate) * 12)).otherwise(0).cast("long")


def cumulative(rate: Column) -> Column:
    """The cumulative Poisson probabilities of a rate from first_count(rate) to 12 deviations above it."""
    first = first_count(rate)
    reach = (F.ceil(F.sqrt(rate) * 12 + F.when(rate > FROM_ZERO, F.sqrt(rate) * 12).otherwise(rate)) + 16).cast("int")
    # the probability of `first` by Stirling's series, which is exact to rounding for counts this large
    k = F.greatest(first, F.lit(1)).cast("double")
    large = F.exp(k - rate + k * F.log(rate / k) - F.log(2 * F.pi() * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
    low = F.when(rate > FROM_ZERO, large).otherwise(F.exp(-rate))
    start = F.struct(low.alias("term"), low.alias("sum"), F.array(low).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / (first + k)
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), reach), start, step, lambda acc: acc["all"])


def poisson_count(first: Column, table: Column, u: Column) -> Column:
    """The smallest count whose cumulative probability exceeds u: `first` and so many more as entries of `table` do not, by bisection."""
    whole = F.struct(F.lit(0).alias("low"), F.size(table).alias("high"))  # entries below `low` do not exceed u, those from `high` on do

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = (acc["low"] < acc["high"]) & (u >= F.get(table, mid))
        return F.struct(F.when(less, mid + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(F.least(mid, acc["high"])).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(table) + 1.0)).cast("int"))
    return first + F.aggregate(steps, whole, step, lambda acc: acc["low"])


def rates(docs: DataFrame, exponent: float = 0.5, budget: float = 1.0, weights: dict[str, float] | None = None, size: str = "n_chars") -> DataFrame:
    """(_source, _rate): the mean number of copies of a document of each source.

    Target weights are given, or in proportion to size ** exponent.  The mixture's expected size is `budget` times the
    input's.  Null sources are one source of their own; sizes are counted over all rows, null or negative as 0; a source of no
    size has rate 0.
    """
    total = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        total = total.withColumn("weight", F.pow("size", F.lit(float(exponent))))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else None
        total = total.withColumn("weight", F.coalesce(F.element_at(given, F.col("_source")), F.lit(0.0)) if given is not None else F.lit(0.0))
    whole = total.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.lit(float(budget)) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(0.0)
    return total.join(F.broadcast(whole)).select("_source", rate.alias("_rate"))  # one row


def mix(docs: DataFrame, seed: int = 7, exponent: float = 0.5, budget: float = 1.0, weights: dict[str, float] | None = None, key: str = "doc_id") -> DataFrame:
    """All columns of `docs`, a row for each copy, with `copy` (from 1) and `mix_key`, dealt out globally by mix_key.

    Columns of these two names in `docs` give way; others, of any name, stay.  Every rate is honoured, however large.  Rows that
    repeat a key draw the same number of copies each; rows without a key draw by their text (where the table has one), so
many of them keep the mean.  An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rate = F.col("_rate")
    tables = written(rates(docs, exponent, budget, weights).select("_source", first_count(rate).alias("_first"), F.when(rate > 0, cumulative(rate)).alias("_table")), "rates")
    plain = [f"c{i}" for i in range(len(names))]  # so that no column of `docs` clashes with one of ours
    drawn = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))) if "text" in names else F.col(key)
    own = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)), F.col("source").alias("_of"), uniform(seed, drawn).alias("_u"))
    met = own.join(tables, F.col("_of").eqNullSafe(F.col("_source")), "left").where("_table is not null")
    counted = met.select(*plain, poisson_count(F.col("_first"), F.col("_table"), F.col("_u")).alias("_n")).where("_n > 0")
    part = counted.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(AT_ONCE).cast("long"))))
    copies = part.select(*plain, F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + (AT_ONCE - 1))).cast("array<int>")).alias("copy"))
    copies = copies.select(*(F.col(p).alias(c) for c, p in zip(names, plain, strict=True)), "copy")
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col("copy"), *(F.col(f"`{c}`") for c in names if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")

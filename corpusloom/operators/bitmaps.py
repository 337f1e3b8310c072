"""Distinct counts that merge: bitmaps of identities by group and word of 64, written once, OR-ed by whoever asks for coarser groups.

A row is a group's share of one word, so a group of few identities has few rows of 8 bytes, however far these lie apart.  Whole numbers are their own places;
other identities get dense ordinals by a two-level prefix scan.  A count over any union of groups is the OR of their words, with partial
aggregates by task; no identity is read again, and no row is expanded for each count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stream import running


def ordinals(rows: DataFrame, identity: str) -> DataFrame:
    """(identity, _ordinal): distinct identities numbered from 0; nulls have none."""
    return running(rows.where(F.col(identity).isNotNull()).select(identity).distinct(), [identity], {"_ordinal": F.lit(1)})


def bitmaps(rows: DataFrame, identity: str, *groups: str) -> DataFrame:
    """(groups, bucket, bits): the identities of each group; null groups are groups."""
    if isinstance(rows.schema[identity].dataType, T.IntegralType):
        known = rows.where(F.col(identity).isNotNull()).select(*groups, F.col(identity).cast("long").alias("_ordinal"))
    else:
        known = rows.select(*groups, identity).join(ordinals(rows, identity), identity)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_ordinal").bitwiseAND(F.lit(63)).cast("int"))
    place = known.select(*groups, F.shiftright("_ordinal", 6).alias("bucket"), bit.alias("_bit"))
    return place.groupBy(*groups, "bucket").agg(F.bit_or("_bit").alias("bits"))


def merged(made: DataFrame, *groups: str) -> DataFrame:
    """Bitmaps of coarser groups: `groups` are some of those that `made` has."""
    return made.groupBy(*groups, "bucket").agg(F.bit_or("bits").alias("bits"))


def counts(made: DataFrame, *groups: str, name: str = "n") -> DataFrame:
    """(groups, n): distinct identities of each of `groups`, exact."""
    return merged(made, *groups).groupBy(*groups).agg(F.sum(F.bit_count("bits")).cast("long").alias(name))

"""Annotation features and locators as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features with standard names.
STANDARD = {"POS": "part_of_speech", "PERS": "person", "GEN": "gender", "NUM": "number", "CASE": "case", "MOOD": "mood"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(parts: Column, mark: str, bare: str | None) -> Column:
    """Key to value with the last one winning, whatever the session's map policy: keys once, each with its last value."""
    key = lambda p: F.substring_index(p, mark, 1)
    value = lambda p: F.when(p.contains(mark), F.substring(p, F.length(key(p)) + F.lit(len(mark) + 1), F.length(p))).otherwise(F.lit(bare))

    def made(keyed: Column) -> Column:
        last = lambda k: value(F.element_at(F.filter(keyed, lambda p: key(p) == k), -1))
        several = lambda keys: F.map_from_arrays(keys, F.transform(keys, last))
        once = lambda keys: F.map_from_arrays(keys, F.transform(keyed, value))
        return let(F.array_distinct(F.transform(keyed, key)), lambda keys: F.when(F.size(keys) == F.size(keyed), once(keys)).otherwise(several(keys)))

    return let(parts if bare is not None else F.filter(parts, lambda p: p.contains(mark)), made)


def feature_struct(raw: Column) -> Column:
    """raw_text, fragments (duplicates kept) and native map of pipe-separated KEY:VALUE features."""
    fragments = F.split(raw, "\\|", -1)
    return F.struct(raw.alias("raw_text"), fragments.alias("fragments"), _map(fragments, ":", None).alias("native"))


def synthetic_features(raw: Column) -> Column:
    """Map of K=V features; a bare key is "true", empty parts are skipped."""
    return _map(F.filter(F.split(raw, "\\|", -1), lambda p: p != ""), "=", "true")


def standard_features(native: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STANDARD.items() for x in kv))
    return F.transform_keys(F.map_filter(native, lambda k, _: F.array_contains(F.array(*map(F.lit, STANDARD)), k)), lambda k, _: F.element_at(names, k))


def locator(value: Column) -> Column:
    """collection, unit, token and segment (null if absent) of a:b:c[:d]; null unless all are whole numbers of at least 1."""
    ok = value.rlike(r"^[0-9]+:[0-9]+:[0-9]+(:[0-9]+)?$")
    upto = lambda i: F.substring_index(value, ":", i)
    n = lambda i: F.substring_index(upto(i), ":", -1).try_cast("int")
    segment = F.when(upto(3) != value, n(4))
    good = ok & (n(1) > 0) & (n(2) > 0) & (n(3) > 0) & F.coalesce(segment > 0, F.lit(True))
    return F.when(good, F.struct(n(1).alias("collection"), n(2).alias("unit"), n(3).alias("token"), segment.alias("segment")))


def resolved(column: Column, native: Column, key: str) -> Column:
    """The filled column, else the native feature: done once at ingest, so filters reach the scan."""
    return F.coalesce(column, F.element_at(native, key))

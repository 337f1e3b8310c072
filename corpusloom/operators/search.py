"""Text search over a token table (keys, token_no, surface, start, end): filters and windows run in the executors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.normalize import normalize
from .stream import owners, with_halo


def values(tokens: DataFrame, profile: str | None = None) -> DataFrame:
    """Adds `value`: the raw surface or its normalized form."""
    return tokens.withColumn("value", F.col("surface") if profile is None else normalize(F.col("surface"), profile))


def exact(tokens: DataFrame, surface: str) -> DataFrame:
    return tokens.where(F.col("surface") == surface)


def normalized(tokens: DataFrame, value: str, profile: str) -> DataFrame:
    """`value` is compared as given."""
    return values(tokens, profile).where(F.col("value") == value)


def missing_normalized(tokens: DataFrame, done: DataFrame, profile: str) -> DataFrame:
    """(token_id, profile, value) of the tokens that `done` (token_id, profile) lacks under this profile: what an incremental run appends."""
    have = done.where(F.col("profile") == profile).select("token_id")
    rows = tokens.join(have, "token_id", "left_anti")
    return values(rows, profile).select("token_id", F.lit(profile).alias("profile"), "value")


def in_units(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """Tokens with their unit's columns: the inner join by unit_id."""
    return tokens.join(units, "unit_id")


def with_normalized(tokens: DataFrame, units: DataFrame, normalized_tokens: DataFrame, profile: str) -> DataFrame:
    """Tokens with their unit and stored normalized value under one profile; tokens without a value are not in it."""
    return in_units(tokens, units).join(normalized_tokens.where(F.col("profile") == profile).select("token_id", "value"), "token_id")


def occurrences(text: Column, pattern: str) -> Column:
    """0-based starts of all occurrences, overlapping ones included; an empty pattern has none."""
    none = F.array().cast("array<int>")
    if not pattern:
        return none
    # cutting before every occurrence makes each piece but the first start with one; an occurrence at 0 cuts nothing
    pieces = F.split(text, f"(?={re.escape(pattern)})", -1)
    first = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, F.lit(pattern)), F.array(F.lit(0))).otherwise(none).alias("out"))
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(pieces, i))).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(F.get(pieces, i)))).alias("out")
    )
    walked = F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 2), first, step, lambda acc: acc["out"])
    return F.when(F.size(pieces) > 1, walked).otherwise(first["out"])


def substring(units: DataFrame, tokens: DataFrame, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, start, end, token_no): hits, with the token that covers each whole hit (null if none does): one sweep over starts of tokens and hits."""
    hits = units.where(F.col(text).contains(pattern)).select(*keys, F.explode(occurrences(F.col(text), pattern)).alias("start"))
    met = owners(hits, tokens.select(*keys, "token_no", "start", "end"), keys, "start")
    end = F.col("start") + len(pattern)
    return met.select(*keys, "start", end.alias("end"), F.when(F.col("_owner_end") >= end, F.col("token_no")).alias("token_no"))


def phrase_in_units(units: DataFrame, phrase: str, keys: list[str], text: str = "text", profile: str | None = None) -> DataFrame:
    """(keys, token_no, start, phrase_end) of every hit inside one unit, overlapping ones included: found in the unit's own row, so nothing is shuffled."""
    words = phrase.split()
    if not words:
        raise ValueError("a phrase needs a word")
    named = F.struct(tx.surfaces(F.col(text)).alias("w"), F.split(F.col(text), tx.WORD, -1).alias("g"))
    rows = units.where(F.contains(F.col(text), F.lit(words[0])) if profile is None else F.lit(True)).select(*keys, F.explode(F.array(named)).alias("_x"))  # once a row
    value = lambda i: F.get("_x.w", i) if profile is None else normalize(F.get("_x.w", i), profile)

    def same(i: Column) -> Column:
        out = value(i) == words[0]
        for k, w in enumerate(words[1:], 1):
            out &= value(i + k) == w
        return F.coalesce(out, F.lit(False))

    hits = rows.where(F.size("_x.w") >= len(words)).select(*keys, "_x", F.explode(F.filter(F.sequence(F.lit(0), F.size("_x.w") - len(words)), same)).alias("_i"))
    length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))
    i, m = F.col("_i"), len(words)
    start, end = length(F.col("_x.g"), i + 1) + length(F.col("_x.w"), i), length(F.col("_x.g"), i + m) + length(F.col("_x.w"), i + m)
    return hits.select(*keys, (i + 1).alias("token_no"), start.alias("start"), end.alias("phrase_end"))


def frequency(tokens: DataFrame, profile: str | None = None) -> DataFrame:
    return values(tokens, profile).groupBy("value").agg(F.count("*").alias("n"))


def word_frequency(units: DataFrame, text: str = "text", profile: str | None = None) -> DataFrame:
    """(value, n) as `frequency` of the units' tokens: each batch counts its words first, so a row a word of a batch is shuffled and normalized, not a row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: Counter[str] = Counter()
            for value in batch.column(0).to_pylist():
                met.update((value or "").split())
            yield pa.record_batch([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["surface", "n"])

    counted = units.select(F.col(text).cast("string")).mapInArrow(run, "surface string, n long")
    return values(counted, profile).groupBy("value").agg(F.sum("n").alias("n"))


def stream_window(tokens: DataFrame, n: int, keys: list[str], cross_unit: bool) -> tuple[DataFrame, list[str], Column]:
    """(rows, partition and order of windows of n tokens, which rows may start one): inside units, or over the whole stream in the order of `keys`."""
    if not cross_unit:
        return tokens, [*keys, "token_no"], F.lit(True)
    rows, home, (part, at) = with_halo(tokens, [*keys, "token_no"], n)
    return rows, [part, at], home


def phrase(tokens: DataFrame, text: str, keys: list[str], profile: str | None = None, cross_unit: bool = False) -> DataFrame:
    """Runs of tokens equal to the phrase's words; overlapping hits are kept.

    Runs stay in one unit, or with `cross_unit` go over the ends of units and collections, as the whole table is one stream.
    """
    words = text.split()
    if not words:
        raise ValueError("a phrase needs a word")
    rows, (*part, order), home = stream_window(values(tokens, profile), len(words), keys, cross_unit)
    win = Window.partitionBy(*part).orderBy(order)
    hit = F.col("value") == words[0]
    for i, w in enumerate(words[1:], 1):
        hit &= F.lead("value", i).over(win) == w
    last = F.lead("end", len(words) - 1).over(win) if len(words) > 1 else F.col("end")
    found = rows.withColumns({"_hit": hit & home, "phrase_end": last}).where("_hit")
    return found.select(*tokens.columns, "value", "phrase_end") if "value" not in tokens.columns else found.select(*tokens.columns, "phrase_end")


def repeated_ngrams(tokens: DataFrame, n: int, keys: list[str], profile: str | None = None, locations: bool = False, cross_unit: bool = False) -> DataFrame:
    """(gram, n, sequence_sha256[, locations]): runs of 2..10 tokens met more than once; gram joins the words by one space, the hash tells apart
    sequences whose joined words agree.

    Runs stay in one unit, or with `cross_unit` go over the ends of units and collections.
    """
    if not 2 <= n <= 10:
        raise ValueError("n must be from 2 to 10")
    words = values(tokens, profile).select(*keys, "token_no", "value")  # whatever else tokens carry stays behind
    rows, (*part, order), home = stream_window(words, n, keys, cross_unit)
    win = Window.partitionBy(*part).orderBy(order).rowsBetween(0, n - 1)
    found = rows.withColumns({"_gram": F.collect_list("value").over(win), "_home": home}).where((F.size("_gram") == n) & F.col("_home"))
    sized = F.array_join(F.transform("_gram", lambda w: F.concat(F.octet_length(w).cast("string"), F.lit(":"), w)), "")
    found = found.select(F.array_join("_gram", " ").alias("gram"), F.sha2(sized, 256).alias("sequence_sha256"), *keys, "token_no")
    gram = ["gram", "sequence_sha256"]
    if not locations:
        return found.groupBy(*gram).agg(F.count("*").alias("n")).where("n > 1")
    met = found.withColumn("n", F.count("*").over(Window.partitionBy(*gram))).where("n > 1")  # one shuffle counts and gathers
    return met.groupBy(*gram, "n").agg(F.array_sort(F.collect_list(F.struct(*keys, "token_no"))).alias("locations"))

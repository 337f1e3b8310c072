"""Operator 8: MinHash near-duplicates with tensored banding.

Two collections of `tables` short sketches (`rows` minhashes each) are computed for a set of word shingles; table keys are all
pairs (sketch of the first, sketch of the second), so tables**2 tables cost 2 * tables * rows minhashes, about the
square root of computing each table's own.  Equal sets collapse first.  In each bucket every set is compared
with the smallest document only (a grouped minimum and a join: no pairs within a group); pairs whose minhashes agree
often enough are confirmed on full sets.  After components are known, buckets that still hold several components
are compared across components, so links that miss their bucket's smallest document are found as well; shingles that no other set there holds rule most of these pairs out.

A pair at the similarity threshold s shares a table with probability (1 - (1 - s**rows)**tables)**2: 0.99993 at
s = 0.85 with 8 tables of 2, 0.99993 at s = 0.8 with 10.  The agreement filter lets 0.999999 of such pairs through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import components, discard, mapped, written


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each document of a block, sorted within it, and each document's range.

    A-Z are lowered; a document of 1 to size - 1 words has its whole sequence as one shingle.
    """
    data = tx.LOWER[data]
    starts, ends, own = tx.words(data, offs)
    rolled = tx.Rolling(tx.hash_spans(data, starts, ends, 21), 0x5851F42D4C957F2D)
    counts = np.diff(own)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = tx.ranges(own[:-1], number)
    hashed = rolled.spans(first, first + np.repeat(np.minimum(counts, size), number))
    parts, upto = [], np.zeros(len(counts) + 1, np.int64)
    at = np.concatenate([[0], np.cumsum(number)])
    for i in range(len(counts)):
        part = hashed[at[i] : at[i + 1]]
        if len(part) > 1:
            part = np.sort(part)
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        upto[i + 1] = upto[i] + len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, tx.U64)), upto


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = tx.mix(np.arange(1, 2 * n + 1, dtype=tx.U64) * tx.U64(0x9E3779B97F4A7C15))
    return k[:n], k[n:] | tx.U64(1)


def sketch(hashed: np.ndarray, upto: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (int32) of each nonempty set: high halves of xor-multiply hashes of well mixed values."""
    full = np.diff(upto) > 0
    out = np.zeros((len(full), n), np.int32)
    if not full.any():
        return out
    at = upto[:-1][full]
    flip, times = seeds(n)
    for k in range(n):
        out[full, k] = np.minimum.reduceat((((hashed ^ flip[k]) * times[k]) >> tx.U64(32)).astype(np.uint32), at).view(np.int32)
    return out


#: Of the two set fingerprints.
SALTS = (0x1234567, 0x89ABCDEF)


def fingerprint(hashed: np.ndarray, upto: np.ndarray, salt: int) -> np.ndarray:
    """The sum of salted mixes of each set's members, modulo 2**64."""
    total = np.concatenate([[tx.U64(0)], np.cumsum(tx.mix(hashed ^ tx.U64(salt)), dtype=tx.U64)])
    return tx.signed(total[upto[1:]] - total[upto[:-1]])


#: Words of 64 parity bits of an odd sketch, and its salt.
ODD_WORDS, ODD_SALT = 16, 0x0DD5EED


def odd_sketch(hashed: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The parity of each set's members in each of 64 * ODD_WORDS cells: two sets differ in no fewer members than their sketches in bits."""
    sets = len(upto) - 1
    out = np.zeros(sets * ODD_WORDS, tx.U64)
    cell = tx.mix(hashed ^ tx.U64(ODD_SALT))
    word = np.repeat(np.arange(sets), np.diff(upto)) * ODD_WORDS + (cell % tx.U64(ODD_WORDS)).astype(np.int64)
    np.bitwise_xor.at(out, word, tx.U64(1) << (cell >> tx.U64(58)))
    return out


def signatures(docs: DataFrame, size: int, n: int) -> DataFrame:
    """(doc_id, n_shingles, s0, s1, sig) of every row; s0, s1 fingerprint the set by sums over its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs):
                hashed, upto = shingles(d, o, size)
                sums = [pa.array(fingerprint(hashed, upto, salt)) for salt in SALTS]
                sig = pa.FixedSizeListArray.from_arrays(pa.array(sketch(hashed, upto, n).ravel()), n).cast(pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0)[i:j], pa.array(np.diff(upto)), *sums, sig], names=["doc_id", "n_shingles", "s0", "s1", "sig"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_shingles long, s0 long, s1 long, sig array<int>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, s0, members, odd) of every row: its fingerprint, its whole shingle set and the odd sketch of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs):
                hashed, upto = shingles(d, o, size)
                members = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(tx.signed(hashed)))
                odd = pa.FixedSizeListArray.from_arrays(pa.array(tx.signed(odd_sketch(hashed, upto))), ODD_WORDS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0)[i:j], pa.array(fingerprint(hashed, upto, SALTS[0])), members, odd], names=["id", "s0", "members", "odd"])

    return mapped(docs.select("id", "text"), run, "id long, s0 long, members array<long>, odd array<long>")


def agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def least_agreement(n: int, similarity: float) -> int:
    """The largest count that n Bernoulli(similarity) draws reach with probability 0.999999."""
    from math import comb

    below = 0.0
    for k in range(n + 1):
        below += comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > 1e-6:
            return k
    return n


class NearDuplicates:
    """Links and components of the distinct shingle sets of `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int = 3, percent: int = 85, tables: int = 8, rows: int = 2):
        self.docs, self.size, self.percent, self.tables, self.rows = docs, size, percent, tables, rows
        self.n = 2 * tables * rows
        self.least = least_agreement(self.n, percent / 100)
        self.signed = written(signatures(docs, size, self.n), "signatures")
        some = self.signed.where("n_shingles > 0 and doc_id is not null")
        ids = some.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
        self.repeated = ids["n"] != ids["d"]
        if self.repeated:  # of rows that share a doc_id, the smallest set stands for it
            some = some.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "s0", "s1", "sig")).alias("x")).select("doc_id", "x.*")
        #: One row for each distinct set, by its smallest document.
        self.sets = written(some.groupBy("s0", "s1", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "sets")

    def keyed(self) -> DataFrame:
        """(key, id): tables ** 2 rows for each distinct set."""
        first = self.sets.select("id", self.half(1).alias("second"), F.explode(self.half(0)).alias("x"))
        return first.select("id", "x", F.explode("second").alias("y")).select(F.xxhash64("x", "y").alias("key"), "id")

    def half(self, side: int) -> Column:
        """The sketches of one collection: array<long>, `tables` long."""
        at, r = side * self.tables * self.rows, self.rows
        return F.array(*(F.xxhash64(F.lit(at + k), *(F.col("sig")[at + k * r + i] for i in range(r))) for k in range(self.tables)))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose set sizes and minhashes allow the similarity."""
        side = lambda c: self.sets.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        fits = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & (agreement(F.col("sa"), F.col("sb")) >= self.least)
        return met.where(fits).select("a", "b", "na", "nb")

    def members(self, need: DataFrame, name: str) -> DataFrame:
        """(id, s0, members, odd) of the sets `need` (id) names."""
        texts = self.docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        texts = texts.join(need.hint("merge"), "id", "left_semi")  # ids grow with the corpus: never a broadcast
        full = full_sets(texts, self.size)
        if self.repeated:
            full = full.join(self.sets.select("id", "s0"), ["id", "s0"], "left_semi").dropDuplicates(["id"])
        return written(full, name, large=True)

    def confirmed(self, pairs: DataFrame, full: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b, na, nb, ...) and linked: whether 100 * intersection >= percent * union on full sets."""
        if full is None:
            full = self.members(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "members")
        met = pairs.join(full.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        both = F.size(F.array_intersect("ma", "mb")).cast("long")
        return met.select(*pairs.columns, (100 * both >= self.percent * (F.col("na") + F.col("nb") - both)).alias("linked"))

    def linked(self) -> tuple[DataFrame, DataFrame | None]:
        """(node, component) after the first phase, and (node, component) of those components that links across them merge, if any.

        Components of the second phase are taken of the first's as nodes, so they cost the links across alone.
        """
        keyed = self.keyed()
        crowded = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
        crowded = written(crowded, "crowded")  # known before the join, so that a crowded key can be split
        star = keyed.join(crowded, "key").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"), "key")
        star = written(star, "buckets", large=True)
        judged = written(self.confirmed(written(self.alike(star.select("a", "b").distinct()), "pairs")).select("a", "b", "linked"), "judged", large=True)
        labels = written(components(judged.where("linked").select("a", "b")), "labels")
        more, full = self.across(star, judged, labels)
        merged = None
        if more.take(1):
            merged = components(self.confirmed(more, full).where("linked").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        discard(star, judged)
        return labels, merged

    def across(self, star: DataFrame, judged: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of different components that share a bucket and may still link, and the full sets of their buckets.

        A shingle that only one set of all these buckets holds is in no intersection.  A set's other shingles bound
        each of its intersections, and two sets of sizes n and m need percent * (n + m) / (100 + percent) common ones: an exact
        test that turns away edited copies by their own edits, inside the join, before any pair exists.  So does a second one:
        linked sets differ in (100 - percent) * (n + m) / (100 + percent) members at most, and so do the bits of their odd sketches.
        """
        label = labels.select(F.col("node").alias("id"), F.col("component").alias("c"))
        member = star.select("key", F.col("a").alias("id")).union(star.select("key", F.col("b").alias("id")).distinct())
        member = member.join(label, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
        mixed = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("id").alias("n")).where("low < high and n > 2").select("key")
        mixed = written(mixed, "mixed-keys")
        member = written(member.join(mixed, "key"), "mixed")
        full = self.members(member.select("id").distinct(), "mixed-members")
        alone = full.select("id", F.explode("members").alias("g")).groupBy("g").agg(F.count("id").alias("n"), F.min("id").alias("id")).where("n = 1")
        alone = alone.groupBy("id").agg(F.count("g").alias("alone"))
        known = self.sets.join(full.select("id", "odd"), "id").join(alone, "id", "left")
        known = written(known.select("id", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("shared"), "sig", "odd", self.half(0).alias("first"), self.half(1).alias("second")), "known")
        # a set that fits no set of the least possible size fits none
        fits = known.where(F.col("shared") * (100 + self.percent) * 100 >= self.percent * (100 + self.percent) * F.col("n"))
        member = member.join(fits, "id")
        one, two = member.alias("x"), member.alias("y")
        close = (F.col("x.id") > F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & (100 * F.least("x.n", "y.n") >= self.percent * F.greatest("x.n", "y.n"))
        close &= (100 + self.percent) * F.least("x.shared", "y.shared") >= self.percent * (F.col("x.n") + F.col("y.n"))
        # the cheap test of bits goes before those that walk arrays
        apart = reduce(add, (F.bit_count(F.col("x.odd")[k].bitwiseXOR(F.col("y.odd")[k])) for k in range(ODD_WORDS)))
        close &= (100 + self.percent) * apart <= (100 - self.percent) * (F.col("x.n") + F.col("y.n"))
        close &= agreement(F.col("x.sig"), F.col("y.sig")) >= self.least
        # of the buckets that both are in, the first gives the pair
        same = lambda side: F.get(F.filter(F.zip_with(f"x.{side}", f"y.{side}", lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull()), F.lit(0))
        close &= F.col("x.key") == F.xxhash64(same("first"), same("second"))
        more = one.join(two, (F.col("x.key") == F.col("y.key")) & close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()
        return written(more.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "across"), full

    def labelled(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every row of docs.

        Empty texts and null texts have no set and link with nothing.  A component is named by its smallest doc_id;
        `kept` marks that document.  Of rows that share a doc_id, the one with the smallest set takes part in linking; the
        others get the component of an equal set, or their own doc_id.  Null doc_ids link with nothing.
        """
        first, merged = self.linked()
        named = self.sets.join(first.withColumnRenamed("node", "id"), "id", "left").select("s0", "s1", F.col("n_shingles").alias("_n"), F.coalesce("component", "id").alias("component_id"))
        if merged is not None:
            named = named.join(merged.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("component_id", F.coalesce("component", "component_id")).drop("component")
        rows = self.signed.select("doc_id", "n_shingles", "s0", "s1")
        same = (rows["s0"] == named["s0"]) & (rows["s1"] == named["s1"]) & (rows["n_shingles"] == named["_n"]) & rows["doc_id"].isNotNull()
        out = rows.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, tables: int = 8, rows: int = 2) -> DataFrame:
    return NearDuplicates(docs, size, percent, tables, rows).labelled()

"""Operator 11: phrase collocations from packed ids of frequent words.

1. Blocks of text count their words by language; a grouped sum gives the *dictionary*: words met at least `least` times in their language,
   numbered by descending count.  A word is known by a 64-bit hash of language and word; the same grouped sum sees
   two words under one hash (least and greatest), and another seed is then taken.
2. Texts are encoded once: runs of ids, 0 wherever a piece ends or a word is not in the dictionary, as no phrase with a rarer word can be
   frequent.  Ids say the language.
3. For 2, 3 and 4 words, each block packs its runs into keys of four bytes a word, big-endian, so byte order is id order; sorts them by radix and counts runs.
   These rows are range-partitioned by key, and each partition merges what it gets in the same way, in bounded portions.  Longer phrases are packed
   only where both shorter ones inside may be frequent: a bit array of fixed size tells, whose false alarms cost time and no result.
4. Cuts, scores and what longer phrases take over are joins and grouped extremes over frequent phrases.

The dictionary goes to every worker as a file while it has at most LOOKUP words; a larger one is joined to the distinct words of each block instead,
and only those reach the block's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import discard, mapped, new_path, opened, written

#: Words of a phrase at most.
LONGEST = 4
#: Words of a dictionary that every worker may hold (12 bytes each).
LOOKUP = 1 << 22
#: Bits of the array that tells which shorter phrases may be frequent (16 MB).
FILTER_BITS = 27
#: Keys of a portion that is sorted at once; a partition of the merge gets about as many.
PORTION = 1 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of uint32 columns, most significant first: a stable pass for each 16-bit digit, the last digit first."""
    order = None
    for c in reversed(columns):
        for shift in (0, 16):
            digit = (c >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def counted(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order and their counts (or sums of weights): radix sort, then run lengths."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n)) if weights is None else np.add.reduceat(weights[order], at)
    return [c[at] for c in columns], size.astype(np.int64)


def packed(columns: list[np.ndarray]) -> pa.Array:
    """Binary keys of four big-endian bytes a word."""
    n, width = len(columns[0]), 4 * len(columns)
    data = np.stack(columns, axis=1).astype(">u4").tobytes() if n else b""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def unpacked(keys: pa.Array, words: int) -> list[np.ndarray]:
    _, offs, data = keys.buffers()
    first = np.frombuffer(offs, np.int32, 1, keys.offset * 4)[0] if len(keys) else 0
    table = np.frombuffer(data, ">u4", len(keys) * words, int(first)).reshape(-1, words) if len(keys) else np.zeros((0, words), ">u4")
    return [table[:, k].astype(np.uint32) for k in range(words)]


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows, for the bit array."""
    h = np.zeros(len(columns[0]), tx.U64)
    for c in columns:
        h = tx.mix(h ^ c.astype(tx.U64) * tx._K + tx._K)
    return h >> tx.U64(64 - FILTER_BITS)


class Words:
    """Words of a block of texts with the hash of language and word, and whether a piece goes on before them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: np.ndarray, seed: int):
        self.data = tx.LOWER[data]
        gap = _GAPS[self.data] if len(data) else np.zeros(0, bool)
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        at = offs[:-1][offs[:-1] < len(data)]
        first[at] = ~gap[at]
        at = offs[1:][offs[1:] > 0] - 1
        last[at] = ~gap[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        own = np.searchsorted(self.starts, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(own))
        self.hash = tx.mix(tx.hash_spans(self.data, self.starts, self.ends, seed) ^ langs[self.row]) if len(self.starts) else np.zeros(0, tx.U64)
        broken = np.concatenate([[0], np.cumsum(_BREAKS[self.data])]) if len(data) else np.zeros(1, np.int64)
        self.goes_on = np.zeros(len(self.starts), bool)
        self.goes_on[1:] = (self.row[1:] == self.row[:-1]) & (broken[self.starts[1:]] == broken[self.ends[:-1]])

    def strings(self, at: np.ndarray) -> pa.Array:
        size = self.ends[at] - self.starts[at]
        data = self.data[tx.ranges(self.starts[at], size)]
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())

    def ids(self, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Ids of all words with 0 for unknown ones and between pieces."""
        got = np.zeros(len(self.hash), np.uint32)
        if len(known):
            at = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
            got = np.where(known[at] == self.hash, ids[at], 0).astype(np.uint32)
        breaks = np.flatnonzero(~self.goes_on)
        return np.insert(got, breaks, 0)


def blocks_of(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, int, Words, pa.Array]]:
    data, offs = tx.string_column(batch, "text")
    langs = batch.column(batch.schema.get_field_index("lang"))
    raw, at = tx.string_column(batch, "lang")
    salt = tx.hash_spans(raw, at[:-1], at[1:], 77)
    for i, j, d, o in tx.blocks(data, offs):
        yield i, j, Words(d, o, salt[i:j], seed), langs[i:j]


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, n): words of each block; h and word are null for all words of a language in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, langs in blocks_of(batch, seed):
                kinds, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                names = langs.take(pa.array(w.row[first]))
                yield pa.record_batch([names, pa.array(tx.signed(kinds)), w.strings(first), pa.array(n.astype(np.int64))], names=["lang", "h", "word", "n"])
                rows, n = np.unique(w.row, return_counts=True)
                none = lambda t, k=len(rows): pa.nulls(k, t)
                yield pa.record_batch([langs.take(pa.array(rows)), none(pa.int64()), none(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "h", "word", "n"])

    return mapped(docs, run, "lang string, h long, word string, n long")


def dictionary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """((id, h, lang, word, n), (lang, n), seed): frequent words numbered from 1 by descending count, and all words of each language.

    Numbers come from counts of sorted partitions (one row each at the driver), not from one window.
    """
    for seed in range(31, 39):
        own = F.when(F.col("h").isNull(), F.col("lang")).alias("_all")
        one = F.struct("lang", "word")
        counts = word_counts(docs, seed).groupBy("h", own).agg(F.sum("n").alias("n"), F.min(one).alias("one"), F.max(one).alias("other"))
        found = written(counts.where(f"h is null or n >= {least}").select("h", "one.lang", "one.word", "n", (F.col("one") != F.col("other")).alias("_two")), "words", large=True)
        words = found.where("h is not null")
        if not words.where("_two").head(1):
            break
        discard(found)
    else:
        raise RuntimeError("two frequent words share a hash under every seed")
    order = [F.desc("n"), "lang", "word"]
    dealt = words.select("h", "lang", "word", "n").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "sorted-words")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    base, upto = [], 1
    for p, n in sizes:
        base += [F.lit(p), F.lit(upto)]
        upto += n
    if upto >= 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    start = F.create_map(*base)[part.cast("int")] if base else F.lit(1)
    ids = dealt.select((start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"), "h", "lang", "word", "n")
    return ids, found.where("h is null").select("lang", "n"), seed


@lru_cache(maxsize=1)
def lookup(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, ids) of a dictionary in the shared folder, once a worker."""
    fs, at = opened(path)
    table = pq.read_table(at, columns=["h", "id"], filesystem=fs)
    h = table.column("h").to_numpy().view(tx.U64)
    order = np.argsort(h)
    return h[order], table.column("id").to_numpy().astype(np.uint32)[order]


def encoded(docs: DataFrame, ids: DataFrame, seed: int, lookup_rows: int = LOOKUP) -> DataFrame:
    """(ids array<int>): a row for each block of texts, 0 where no phrase goes on.  Written."""
    size = ids.count()
    if size <= lookup_rows:
        path = new_path(docs.sparkSession, "dictionary")
        ids.select("h", "id").write.parquet(path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for *_, w, _langs in blocks_of(batch, seed):
                    yield listed(w.ids(*lookup(path)))

        return written(mapped(docs, run, "ids array<int>"), "encoded", large=True)
    texts_ = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("_row"))
            for i, _, w, _langs in blocks_of(batch, seed):
                kinds, _ = counted([w.row.astype(np.uint32), (w.hash >> tx.U64(32)).astype(np.uint32), w.hash.astype(np.uint32)])
                h = kinds[1].astype(tx.U64) << tx.U64(32) | kinds[2].astype(tx.U64)
                yield pa.record_batch([rows.take(pa.array(kinds[0].astype(np.int64) + i)), pa.array(tx.signed(h))], names=["_row", "h"])

    wanted = written(mapped(texts_, asked, "_row long, h long"), "asked", large=True)
    own = wanted.join(ids.select("h", "id"), "h").groupBy("_row").agg(F.collect_list(F.struct("h", "id")).alias("own"))  # bounded by a text's own words
    met = texts_.join(own, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(batch.schema.get_field_index("own"))
            for row in range(len(batch)):
                flat = known[row : row + 1].flatten()
                h, n = (flat.field(k).to_numpy() for k in ("h", "id"))
                order = np.argsort(h.view(tx.U64))
                for *_, w, _langs in blocks_of(batch.slice(row, 1), seed):
                    yield listed(w.ids(h.view(tx.U64)[order], n[order]))

    return written(mapped(met.select("text", "lang", "own"), run, "ids array<int>"), "encoded", large=True)


def listed(ids: np.ndarray) -> pa.RecordBatch:
    values = pa.array(ids.view(np.int32))
    return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), values)], names=["ids"])


def grams(codes: DataFrame, words: int, allowed: str | None) -> DataFrame:
    """(key, n): packed phrases of `words` words of each batch of blocks, counted; where `allowed` names a bit array, only those whose shorter ones it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32)  # rows begin with 0, so none runs into the next
            columns = [flat[k : len(flat) - words + 1 + k] for k in range(words)]
            ok = np.all([c != 0 for c in columns], axis=0) if len(flat) >= words else np.zeros(0, bool)
            if allowed and len(ok):
                bits = bit_array(allowed)
                h = mixed([flat[k : len(flat) - words + 2 + k] for k in range(words - 1)])
                inner = (bits[h >> tx.U64(3)] >> (h & tx.U64(7)).astype(np.uint8) & 1).astype(bool)
                ok &= inner[:-1] & inner[1:]
            at = np.flatnonzero(ok)
            for i in range(0, len(at), PORTION):
                kinds, n = counted([c[at[i : i + PORTION]] for c in columns])
                yield pa.record_batch([packed(kinds), pa.array(n)], names=["key", "n"])

    return mapped(codes, run, "key binary, n long")


def merged(rows: DataFrame, words: int, least: int) -> DataFrame:
    """(key, n) of keys with at least `least` in all: range-partitioned, then sorted by radix and counted in portions that are merged as they grow."""
    parts = max(-(-rows.count() // PORTION), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, waiting = ([np.zeros(0, np.uint32)] * words, np.zeros(0, np.int64)), [], 0
        for batch in chain_end(batches):
            if batch is not None:
                held.append((unpacked(batch.column(0), words), batch.column(1).to_numpy()))
                waiting += len(batch)
            if held and (batch is None or waiting >= max(PORTION, len(done[1]))):
                every = [done, *held]
                done = counted([np.concatenate([k[w] for k, _ in every]) for w in range(words)], np.concatenate([n for _, n in every]))
                held, waiting = [], 0
        keep = np.flatnonzero(done[1] >= least)
        yield pa.record_batch([packed([c[keep] for c in done[0]]), pa.array(done[1][keep])], names=["key", "n"])

    return mapped(rows.repartitionByRange(parts, "key"), run, "key binary, n long")


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@lru_cache(maxsize=1)
def bit_array(path: str) -> np.ndarray:
    """The bit array of a table of places, once a worker."""
    fs, at = opened(path)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[pq.read_table(at, columns=["at"], filesystem=fs).column("at").to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def places(frequent: DataFrame, words: int) -> str:
    """Path of the places of frequent phrases in the bit array: at most 2**FILTER_BITS distinct numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(mixed(unpacked(batch.column(0), words))).astype(np.int32))], names=["at"])

    return written(mapped(frequent.select("key"), run, "at int").distinct(), "places")._written_to


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, lookup_rows: int = LOOKUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, words, n) of all frequent phrases from one word up, dictionary, (lang, n) of all words)."""
    docs = texts(docs)
    ids, totals, seed = dictionary(docs, least)
    codes = encoded(docs, ids, seed, lookup_rows)
    single = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    every, allowed = ids.select(single.alias("key"), F.lit(1).alias("words"), "n"), None
    for words in range(2, longest + 1):
        rows = written(grams(codes, words, allowed), f"grams-{words}", large=True)
        now = written(merged(rows, words, least), f"phrases-{words}", large=True)
        discard(rows)
        every = every.unionByName(now.select("key", F.lit(words).alias("words"), "n"))
        if words < longest:
            allowed = places(now, words)
    return every, ids, totals


def part(key: Column, first: Column | int, words: Column | int) -> Column:
    """`words` words of a key from word `first` (from 0)."""
    n = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(key, n(first) * 4 + 1, n(words) * 4)


def scored(every: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, words, lang, a, l, r, score) of phrases of two words or more: of their cuts the lowest score counts, of equal ones the first.

    Whole numbers of 38 digits hold the products.
    """
    cuts = every.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("key", "words", F.col("n").alias("a"), "k", part(F.col("key"), 0, F.col("k")).alias("left"), part(F.col("key"), F.col("k"), F.col("words") - F.col("k")).alias("right"))
    counts = every.select("key", "n")
    both = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("(cast(a as decimal(27,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    low = both.select("key", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("key", "words", "a").agg(F.min("cut").alias("cut"))
    first = ids.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("_first"), "lang")
    return low.withColumn("_first", part(F.col("key"), 0, 1)).join(first, "_first").select("key", "words", "lang", "a", "cut.l", "cut.r", "cut.score")


def standing(phrases: DataFrame, candidates: DataFrame, share: int = 80) -> DataFrame:
    """`candidates` but those that lie in a longer phrase with at least `share` percent of their count."""
    longer = phrases.where("words > 2")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("words") - m), lambda i: part(F.col("key"), i, m))))
    above = longer.select(F.explode(inner).alias("key"), F.col("n").alias("_n")).groupBy("key").agg(F.max("_n").alias("_most"))
    return candidates.join(above, "key", "left").where(F.col("_most").isNull() | (100 * F.col("_most").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)"))).drop("_most")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = LONGEST, lookup_rows: int = LOOKUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count (both descending) and bytes of the phrase.

    `docs` has text and lang; other columns are ignored.  Null texts are empty, null languages `und`; repeated rows count each; an empty
    table gives an empty one.  A first cut by score and count within slices of a language, ties kept, leaves few phrases to spell out.
    """
    every, ids, totals = frequent_phrases(docs, least, longest, lookup_rows)
    left = written(standing(every, scored(every, ids)), "candidates", large=True)
    order = [F.desc("score"), F.desc("a")]
    slices = left.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(256)))
    few = slices.withColumn("_rank", F.rank().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_rank") <= top).drop("_rank", "_slice")
    few = written(few.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= top).drop("_rank"), "first")
    words = few.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: part(F.col("key"), i, 1))).alias("_at", "_id"))
    spelled = words.join(ids.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("_id"), "word"), "_id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("ws"))
    named = few.join(spelled.select("key", F.array_join("ws.word", " ").alias("phrase")), "key").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

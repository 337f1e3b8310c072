"""Operator 6: repeated word windows by De Bruijn compaction, the graph's k-mers dealt by minimizers.

A window of `window` words is an edge of the De Bruijn graph of the corpus, from its first `window` - 1 words to its last
ones.  Windows that share their smallest word k-mer (their anchor) hang together: within a document they form one *path* of
consecutive edges through that anchor, and paths, not edges, move first.

1. Every document emits its paths: anchor hash, span, 128-bit hash of the whole span (about one path for 20 words).
2. Anchors are grouped (minimum, maximum: partial aggregation, so a passage in a third of all documents is no hot key).
   An anchor met in one document holds no repeat.  An anchor with one span hash everywhere has one way in and one way out: no
   edge of its paths *branches*, and they stay compacted.  Paths through other anchors are expanded to their edges, k-mers
   of `window` tokens, which are grouped in the same way.
3. Each repeated path or edge knows its *source coordinates*: smallest document and position there.  Pieces of a document that follow
   each other both there and in their source continue without a branch; two joins find the pieces where such a run begins and
   those where it ends, a third pairs them, and the run is compacted to one span.
4. Source coordinates are followed back to the source's text: a digest of the words there joins each span, and words
   go only if the span's own words have that digest.

Aggregates that meet their rows again are written tables before the join, so both sides of it are plain exchanges and
a key that many documents share is split.  Nothing is paired within a group; work and output grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import discard, mapped, written

#: Bytes of a block: a word has some 20 numbers of eight bytes while its paths or edges are made.
BLOCK = 1 << 21
#: Words of an anchor k-mer.
K = 12
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost smallest value in each run of `width`, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


class Block:
    """Words of a block of documents with their hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, hashes: bool = True):
        self.data = data
        self.starts, self.ends, self.own = tx.words(data, offs)
        if not hashes:
            return
        values = tx.hash_spans(data, self.starts, self.ends, 31)
        self.rolls = [tx.Rolling(values, base) for base in _BASES]

    def paths(self, window: int, k: int) -> dict[str, np.ndarray]:
        """Maximal runs of window starts of a document with the same anchor: row, first, last (in the document), h, span hashes."""
        anchors = self.rolls[0].windows(k)
        at = smallest(anchors, window - k + 1)
        counts = np.maximum(np.diff(self.own) - window + 1, 0)
        start = tx.ranges(self.own[:-1], counts)
        row = np.repeat(np.arange(len(counts)), counts)
        pick = at[start]
        new = np.ones(len(start), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
        a, b = start[first], start[last] + window
        inner = (pick[first] - a).astype(tx.U64)
        base = self.own[row[first]]
        return {
            "row": row[first], "first": a - base, "last": b - window - base, "h": anchors[pick[first]],
            "c0": tx.mix(self.rolls[0].spans(a, b) ^ inner), "c1": tx.mix(self.rolls[1].spans(a, b) + inner),
        }

    def edges(self, starts: np.ndarray, window: int) -> list[np.ndarray]:
        return [r.spans(starts, starts + window) for r in self.rolls]

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each document's words but those marked, joined by one space."""
        keep = np.flatnonzero(~gone)
        own = np.searchsorted(keep, self.own)
        s, e = self.starts[keep], self.ends[keep].copy()
        follow = np.ones(len(keep), bool)
        follow[own[1:][own[1:] > own[:-1]] - 1] = False
        e[follow] += 1
        data = np.append(self.data, np.uint8(0x20))
        data[self.ends[keep[follow]]] = 0x20
        edge = np.zeros(len(data) + 1, np.int8)
        edge[s] += 1
        edge[e] -= 1
        text = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
        upto = np.concatenate([[0], np.cumsum(e - s)])[own].tolist()
        return [text[i:j] for i, j in zip(upto, upto[1:], strict=False)]


def rows_of(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, rid, text) and carried columns: where doc_ids repeat, rid tells rows that share one apart by their text; else it is 0."""
    ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rid = F.xxhash64(text) if ids["n"] != ids["d"] else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), text.alias("text"), *carried)


def paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs, BLOCK):
                got = Block(d, o).paths(window, k)
                row = pa.array(got["row"])
                out = [batch.column(c)[i:j].take(row) for c in (0, 1)]
                out += [pa.array(got[c], pa.int32()) for c in ("first", "last")] + [pa.array(tx.signed(got[c])) for c in ("h", "c0", "c1")]
                yield pa.record_batch(out, names=["doc_id", "rid", "first", "last", "h", "c0", "c1"])

    return mapped(docs, run, "doc_id long, rid long, first int, last int, h long, c0 long, c1 long")


def expanded(met: DataFrame, window: int) -> DataFrame:
    """(doc_id, rid, first, e0, e1): the edges of paths (spans) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            spans = batch.column(3)
            for i, j, d, o in tx.blocks(data, offs, BLOCK):
                block, part = Block(d, o), spans[i:j]
                row, first, last = flat_spans(part)
                size = last - first + 1
                start, own = tx.ranges(first, size), np.repeat(row, size)
                e0, e1 = block.edges(start + block.own[own], window)
                take = pa.array(own)
                out = [batch.column(c)[i:j].take(take) for c in (0, 1)]
                yield pa.record_batch([*out, pa.array(start, pa.int32()), pa.array(tx.signed(e0)), pa.array(tx.signed(e1))], names=["doc_id", "rid", "first", "e0", "e1"])

    return mapped(met.select("doc_id", "rid", "text", "spans"), run, "doc_id long, rid long, first int, e0 long, e1 long")


def flat_spans(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of a list<long> column of first << 32 | last."""
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), flat >> 32, flat & 0xFFFFFFFF


ROW = ["doc_id", "rid"]
#: Source words that share a group of spans to digest: a group is bounded by its document's length, however many rows repeat it.
STRETCH = 64


def coded(first: str, last: str) -> Column:
    return F.shiftleft(F.col(first).cast("long"), 32).bitwiseOR(F.col(last).cast("long"))


def packed(spans: DataFrame) -> DataFrame:
    """(doc_id, rid, spans) from rows with first and last; sizes follow each document's own length."""
    return spans.groupBy(*ROW).agg(F.collect_list(coded("first", "last")).alias("spans"))


def source() -> Column:
    """The coordinates of the smallest document among rows."""
    return F.min(F.struct("doc_id", "rid", "first")).alias("source")


def repeated_pieces(known: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, rid, first, last, s_doc, s_rid, s_first): paths and edges that also start in a document with a smaller doc_id, the smallest."""
    path = written(paths(known, window, k), "paths")
    anchor = path.groupBy("h").agg(
        source(), F.max("doc_id").alias("other"), F.min("c0").alias("c0_low"), F.max("c0").alias("c0_high"), F.min("c1").alias("c1_low"), F.max("c1").alias("c1_high")
    )
    plain = (F.col("c0_low") == F.col("c0_high")) & (F.col("c1_low") == F.col("c1_high"))
    anchor = written(anchor.where("source.doc_id < other").select("h", "source", plain.alias("plain")), "anchors", large=True)
    met = written(path.join(anchor, "h").select(*ROW, "first", "last", "source", "plain"), "anchored", large=True)
    discard(path, anchor)
    branching = packed(met.where("not plain"))
    edge = written(expanded(known.join(branching, ROW), window), "edges", large=True)
    sources = written(edge.groupBy("e0", "e1").agg(source(), F.max("doc_id").alias("other")).where("source.doc_id < other").drop("other"), "sources", large=True)
    single = edge.join(sources, ["e0", "e1"]).select(*ROW, "first", F.col("first").alias("last"), "source")
    both = met.where("plain").select(*ROW, "first", "last", "source").union(single).where("doc_id > source.doc_id")
    out = written(both.select(*ROW, "first", "last", F.col("source.doc_id").alias("s_doc"), F.col("source.rid").alias("s_rid"), F.col("source.first").alias("s_first")), "pieces", large=True)
    discard(met, edge, sources)
    return out


def compacted(pieces: DataFrame) -> DataFrame:
    """The same pieces in as few rows as their runs: those that follow each other in their row and in their source alike are one.

    A piece begins a run if no piece of its row and source ends right before it there, and ends one if none begins right after it.
    """
    run = [*ROW, "s_doc", "s_rid", "shift"]
    some = pieces.withColumn("shift", F.col("s_first") - F.col("first"))
    heads = some.join(some.select(*run, (F.col("last") + 1).alias("first")), [*run, "first"], "left_anti").select(*run, "first")
    tails = some.join(some.select(*run, (F.col("first") - 1).alias("last")), [*run, "last"], "left_anti").select(*run, "last")
    order = Window.partitionBy(*run)  # runs of one row and source: bounded by the row's length
    heads = heads.withColumn("n", F.row_number().over(order.orderBy("first")))
    tails = tails.withColumn("n", F.row_number().over(order.orderBy("last")))
    return heads.join(tails, [*run, "n"]).select(*ROW, "first", "last", "s_doc", "s_rid", (F.col("first") + F.col("shift")).alias("s_first"))


def digests(block: Block, row: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> list[bytes]:
    """Digests of the words under the windows that start at first..last of a row, joined by one space."""
    plain = block.kept(np.zeros(len(block.starts), bool))
    upto = np.concatenate([[0], np.cumsum(block.ends - block.starts + 1)])
    out = []
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
        base = block.own[r]
        begin, end = upto[base + a] - upto[base], upto[base + b + window] - upto[base] - 1
        out.append(hashlib.blake2b(plain[r][begin:end], digest_size=16).digest())
    return out


def with_source_digest(spans: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """`spans` with the digest of the words at their source coordinates, from the source's text."""
    at = ["s_doc", "s_rid", "s_first", "n"]
    spans = spans.withColumn("n", F.col("last") - F.col("first"))
    wanted = spans.select(*at).distinct().withColumn("s_last", F.col("s_first") + F.col("n"))
    wanted = wanted.groupBy("s_doc", "s_rid", F.floor(F.col("s_first") / STRETCH)).agg(F.collect_list(coded("s_first", "s_last")).alias("spans"))
    texts = known.join(wanted.select(F.col("s_doc").alias("doc_id"), F.col("s_rid").alias("rid"), "spans"), ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs, BLOCK):
                row, first, last = flat_spans(batch.column(3)[i:j])
                take = pa.array(row)
                got = pa.array(digests(Block(d, o, hashes=False), row, first, last, window), pa.binary())
                columns = [*(batch.column(c)[i:j].take(take) for c in (0, 1)), pa.array(first, pa.int32()), pa.array(last - first, pa.int32()), got]
                yield pa.record_batch(columns, names=[*at, "digest"])

    found = written(mapped(texts.select(*ROW, "text", "spans"), run, "s_doc long, s_rid long, s_first int, n int, digest binary"), "digests", large=True)
    return spans.join(found, at).select(*ROW, "first", "last", "digest")


def repeated_spans(rows: DataFrame, window: int = 50, k: int = K) -> DataFrame:
    """(doc_id, rid, spans, digests): the runs of window starts of each row that also start in a document with a smaller doc_id."""
    known = rows.where("doc_id is not null").select(*ROW, "text")
    pieces = repeated_pieces(known, window, k)
    spans = written(compacted(pieces), "spans", large=True)
    discard(pieces)
    each = with_source_digest(spans, known, window).withColumn("span", F.struct(coded("first", "last").alias("at"), "digest"))
    out = each.groupBy(*ROW).agg(F.collect_list("span").alias("span"))
    out = written(out.select(*ROW, F.col("span.at").alias("spans"), F.col("span.digest").alias("digests")), "verified", large=True)
    discard(spans)
    return out


def without(rows: DataFrame, spans: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """(doc_id, rid, carried columns, n_words, n_removed, kept_sha256[, kept]) of every row; spans whose digest differs from their words' stay."""
    carried = [c for c in rows.columns if c not in ("doc_id", "rid", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs, BLOCK):
                block = Block(d, o, hashes=False)
                row, first, last = flat_spans(batch.column(3)[i:j])
                told = batch.column(4)[i:j].flatten().to_pylist()
                same = np.array([a == b for a, b in zip(told, digests(block, row, first, last, window), strict=True)], bool)
                row, first, last = row[same], first[same], last[same]
                edge = np.zeros(len(block.starts) + 1, np.int64)
                np.add.at(edge, block.own[row] + first, 1)
                np.add.at(edge, block.own[row] + last + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = block.kept(gone)
                removed = np.concatenate([[0], np.cumsum(gone)])[block.own]
                out = [batch.column(c)[i:j] for c in (0, 1, *range(5, 5 + len(carried)))]
                out += [pa.array(np.diff(block.own)), pa.array(np.diff(removed)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if keep_text:
                    out.append(pa.array([x.decode("utf-8") for x in kept], pa.string()))
                yield pa.record_batch(out, names=["doc_id", "rid", *carried, "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])

    extra = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    schema = f"doc_id long, rid long, {extra}n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return mapped(rows.join(spans, ROW, "left").select("doc_id", "rid", "text", "spans", "digests", *carried), run, schema)


def remove_repeats(docs: DataFrame, window: int = 50, k: int = K, keep_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_words, n_removed, kept_sha256[, kept]) of every row of docs (doc_id, text).

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are judged on the input.  Null
    texts have no words; rows with a null doc_id lose nothing and are no source; rows that share a doc_id are no source
    to each other; texts shorter than the window stay whole (words joined by one space).
    """
    rows = rows_of(docs, *carried)
    return without(rows, repeated_spans(rows, window, k), window, keep_text).drop("rid")

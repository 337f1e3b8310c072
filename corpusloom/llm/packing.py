"""Operator 1: best-fit packing with swap-based local search.

Texts are encoded where they are read; only (document, piece, start, length, digest) rows move.  Rows go to groups by a
hash, and each group of a bounded number of documents is packed by itself: best fit, longest piece first, then a local
search that empties the least filled sequences one after another.  A step moves a piece, or exchanges one for one, two for one or
one for two, between the sequence to empty and any other underfull one that is at least as full, so it raises the sum
of squared fills; of all such steps the one that raises it most is taken.  A sequence that no step empties is left, and the next one
tried; the search ends when the total length says that no fewer sequences can do, or when none can be emptied.

Longest first often reaches that bound by itself, and then the search has nothing left to do; from other orders, the search alone
does not get as far (README).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import mapped
from .tokens import Encoder

#: Documents of a packing group; a group leaves at most about one sequence badly filled.
GROUP_DOCS = 20_000
#: The search of a group ends after so many sequences in a row that it could not empty.
PATIENCE = 4


def pair_sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums ascending, and the two positions) of pairs of `sizes`, of pairs of equal sizes one."""
    kinds, first, count = np.unique(sizes, return_index=True, return_counts=True)
    i, j = np.triu_indices(len(kinds), 1)
    twice = np.flatnonzero(count > 1)
    second = np.array([np.flatnonzero(sizes == kinds[k])[1] for k in twice], np.int64)
    a, b = np.concatenate([first[i], first[twice]]), np.concatenate([first[j], second]).astype(np.int64)
    total = sizes[a] + sizes[b]
    order = np.argsort(total, kind="stable")
    return total[order], a[order], b[order]


class Bins:
    """Sequences of one group: `of` is each piece's sequence, `fill` each sequence's length."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.of = np.zeros(len(sizes), np.int64)
        self.fill = np.zeros(0, np.int64)
        self.steps = 0

    def best_fit(self) -> None:
        """In the given order, each into the fullest sequence that has room; a bit set over free room finds it."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask, fill = 0, []
        for row, size in enumerate(self.sizes.tolist()):
            at = mask >> size
            if at:
                free = size + (at & -at).bit_length() - 1
                b = room[free].pop()
                if not room[free]:
                    mask ^= 1 << free
            else:
                free, b = self.capacity, len(fill)
                fill.append(0)
            self.of[row] = b
            fill[b] += size
            free -= size
            if free:
                if not room[free]:
                    mask |= 1 << free
                room[free].append(b)
        self.fill = np.array(fill, np.int64)

    def exchange(self, out: list[int], to: int, back: list[int]) -> None:
        """Pieces `out` go to sequence `to`, pieces `back` from there to where they were."""
        victim = int(self.of[out[0]])
        delta = int(self.sizes[out].sum() - self.sizes[back].sum())
        self.of[out], self.of[back] = to, victim
        self.fill[to] += delta
        self.fill[victim] -= delta

    def partners(self, victim: int) -> np.ndarray:
        """Of each sequence: may it take from the victim?"""
        ok = (self.fill >= self.fill[victim]) & (self.fill < self.capacity)
        ok[victim] = False
        return ok

    def pairs_within(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, row, row) of the pairs of different sizes within each sequence of `rows`."""
        rows = rows[np.lexsort((self.sizes[rows], self.of[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(self.of[rows]) != 0) | (np.diff(self.sizes[rows]) != 0)
        rows = rows[new]
        one, two, gap = [], [], 1
        while gap < len(rows):
            same = np.flatnonzero(self.of[rows[gap:]] == self.of[rows[:-gap]])
            if not len(same):
                break
            one.append(rows[same])
            two.append(rows[same + gap])
            gap += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        return self.sizes[a] + self.sizes[b], a, b

    def step(self, victim: int) -> bool:
        """The step that raises the squared fills most; False if there is none."""
        mine = np.flatnonzero(self.of == victim)
        mine = mine[np.argsort(self.sizes[mine], kind="stable")]
        have = self.sizes[mine]
        pairs, first, second = pair_sums(have)
        ok, room = self.partners(victim), self.capacity - self.fill
        best, found = 0, None

        def offer(values: np.ndarray, give: np.ndarray, bins: np.ndarray, less: np.ndarray) -> tuple[int, int, int]:
            """(gain, position in `give`, row of bins) of the best exchange of one of the ascending `give` against sizes `less`."""
            if not len(give) or not len(bins):
                return 0, 0, 0
            at = np.searchsorted(values, less + room[bins], "right") - 1
            delta = np.where(at >= 0, values[np.maximum(at, 0)] - less, 0)
            gain = np.where(delta > 0, 2 * delta * (self.fill[bins] - self.fill[victim] + delta), 0)
            k = int(gain.argmax())
            return int(gain[k]), int(at[k]), k

        bins = np.flatnonzero(ok)
        gain, at, k = offer(have, mine, bins, np.zeros(len(bins), np.int64))
        if gain > best:
            best, found = gain, ([int(mine[at])], int(bins[k]), [])
        theirs = np.flatnonzero(ok[self.of])
        gain, at, k = offer(have, mine, self.of[theirs], self.sizes[theirs])
        if gain > best:
            best, found = gain, ([int(mine[at])], int(self.of[theirs[k]]), [int(theirs[k])])
        gain, at, k = offer(pairs, first, self.of[theirs], self.sizes[theirs])
        if gain > best:
            best, found = gain, ([int(mine[first[at]]), int(mine[second[at]])], int(self.of[theirs[k]]), [int(theirs[k])])
        total, a, b = self.pairs_within(theirs)
        gain, at, k = offer(have, mine, self.of[a], total)
        if gain > best:
            best, found = gain, ([int(mine[at])], int(self.of[a[k]]), [int(a[k]), int(b[k])])
        if found:
            self.exchange(*found)
        return found is not None

    def improve(self) -> None:
        """Empty sequences, the least filled first, while the total says that fewer could do; PATIENCE failures in a row end the search."""
        least, stuck = -(-int(self.sizes.sum()) // self.capacity), np.zeros(len(self.fill), bool)
        while int((self.fill > 0).sum()) > least and stuck.sum() < PATIENCE:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~stuck)
            if not len(open_):
                break
            victim = int(open_[self.fill[open_].argmin()])
            while self.fill[victim] and self.step(victim):
                self.steps += 1
            if self.fill[victim]:
                stuck[victim] = True
            else:
                stuck[:] = False  # what was filled meanwhile may help others


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each row; rows of size 0 or above the capacity are not allowed."""
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("sizes must be from 1 to the capacity")
    order = np.argsort(-np.asarray(sizes), kind="stable")
    bins = Bins(np.asarray(sizes, np.int64)[order], capacity)
    bins.best_fit()
    bins.improve()
    of = np.zeros(len(sizes), np.int64)
    of[order] = bins.of
    _, sequence = np.unique(of, return_inverse=True)
    order = np.argsort(sequence, kind="stable")
    upto = np.cumsum(sizes[order]) - sizes[order]
    head = np.concatenate([[True], np.diff(sequence[order]) > 0])[: len(order)]
    offset = np.zeros(len(sizes), np.int64)
    offset[order] = upto - np.maximum.accumulate(np.where(head, upto, 0)) if len(order) else upto
    return sequence.astype(np.int64), offset


def pack(pieces: DataFrame, capacity: int, rows: int, length: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset (long): at most `capacity` tokens a sequence, gapless from 0; columns of these names give way.

    `rows` (about how many documents there are) sets the number of groups.  Rows are dealt to groups by all their columns and their
    partition, so neither null nor repeated keys gather in one group.  Repeated rows are packed each; an empty table gives an empty one.
    """
    groups = max(1, -(-rows // GROUP_DOCS))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["_group"].iloc[0]) if len(frame) else 0
        order = frame.sort_values(["_order", length], kind="stable").reset_index(drop=True)
        sequence, offset = pack_sizes(order[length].to_numpy(np.int64), capacity)
        return order[names].assign(sequence_id=(group << 32) + sequence, offset=offset)

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    dealt = pieces.select(*names, F.xxhash64(*names, F.spark_partition_id()).alias("_order"))
    return dealt.withColumn("_group", F.pmod("_order", F.lit(groups))).groupBy("_group").applyInPandas(run, schema)


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece int, start, length, ids_crc32) of each row's pieces: its ids and the end id, cut only if longer than the capacity.

    Null texts are empty: one piece that holds the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs):
                ids, own = encoder.encode(d, o)
                row, piece, start, size, crc = [], [], [], [], []
                for k in range(j - i):
                    whole = np.append(ids[own[k] : own[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        row.append(i + k)
                        piece.append(p)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                yield pa.record_batch(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.selectExpr(f"`{key}`", f"cast(`{text}` as string) as text"), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as the search finds."""
    return pack(encode_pieces(docs, tokenizer, capacity, end_id), capacity, docs.count())

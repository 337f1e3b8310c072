"""Operator 4: embedding near-duplicates by a hierarchical navigable small-world graph a shard.

Equal vectors collapse first.  A shard is a cap of the sphere: rows go to the nearest of centres drawn by hash, one for SHARD_ROWS rows,
and a cap with more rows is dealt into several shards.  Each builds a graph of its rows, written to the shared folder, and knows the largest angle from its
centre.  Blocks of rows ask every shard: rows whose angle to the centre exceeds that reach by more than the angle of the least cosine are answered by
this bound, which is exact; the others walk the graph.  Nothing is shuffled or copied for it.

Beams are audited twice, against brute force: in the build with planted queries at exactly the least cosine, the hardest there are, and for each block and
shard with a sample of the block's rows.  A beam that misses links is widened while that is worth it; where none passes, the block is compared with
the whole shard, exactly.
Rows whose beam shows a link, or nearly, are compared with the whole shard too, so groups of any size are found whole; an exact check of the
others follows, which costs less than their walk: a bound by some of the components rules out most pairs.  Pairs are verified in double precision where
rounding could decide.  A block returns, for each row, how many rows it links to and a spanning forest of the links instead of all pairs.

Rows of a table are searched for in all shards that the bounds cannot rule out: where data have no clusters, work grows with rows times shards.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import components, mapped, new_path, opened, remove, written
from .vectors import BLOCK_ROWS, LEAST_SHARDS, SHARD_ROWS, finite, matrix

#: Neighbours of a node above the ground and on it, and the beam when building.
M, M0, BUILD_BEAM = 12, 24, 32
#: First beam, its growth, share of audited queries (at least AUDIT_LEAST of a block), share of links that they
#: are to find on average, planted queries of a shard.
BEAM, WIDEN, AUDIT_EACH, AUDIT_LEAST, RECALL, PLANTED = 48, 2, 64, 48, 0.98, 512
#: Nodes of a shard for each place of the widest beam: a wider one takes longer than comparing all of the shard, which is exact (a walk with beam 48 takes as
#: long as some 70,000 comparisons of 64 components).
WORTH = 1024
#: Open nodes of a beam that a step visits at once.
AT_ONCE = 4
#: Components of a shard's vectors at most.
SHARD_CELLS = 1 << 24
#: Cells of a lockstep visited table, or of a block of similarities.
CELLS = 1 << 24
#: Queries and nodes of a block of comparisons: it stays in a core's cache.
TILE = 256, 2048
#: Share of the components that a comparison begins with, and the fewest it is worth it for.
HEAD, HEAD_LEAST = (3, 8), 8
#: A beam that comes so near to the least similarity is taken to show a link.
NEARLY = 0.05
#: What single precision may be off by.
EDGE = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow for any finite nonzero input."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bounded(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Some components of unit rows, and the length of the others: the product of two such rows is at least that of the whole ones."""
    head = x[:, heads]
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("kd,kd->k", head, head)))
    return np.concatenate([head, rest[:, None]], 1)


def reaching(sims: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that are no less; rows without any are told by their largest, which is faster."""
    some = np.flatnonzero(sims.max(1) >= least)
    r, c = np.divmod(np.flatnonzero(sims[some] >= least), sims.shape[1])
    return some[r], c


class Graph:
    def __init__(self, vectors: np.ndarray, keys: np.ndarray):
        """`vectors` are unit rows; levels follow from the keys' hashes, so a rebuilt graph is the same."""
        self.exact = vectors
        self.x = vectors.astype(np.float32)
        u = (tx.mix(keys.astype(np.int64).view(tx.U64) + tx.U64(0x9E3779B97F4A7C15)) >> tx.U64(11)).astype(np.float64) / float(1 << 53)
        self.level = np.minimum(-np.log(np.maximum(u, 1e-16)) / np.log(M), 12).astype(np.int64)
        n, self.top = len(vectors), int(self.level.max(initial=0))
        self.near = [np.full((n if not k else int((self.level >= k).sum()), M if k else M0), -1, np.int32) for k in range(self.top + 1)]
        self.place = [np.cumsum(self.level >= k) - 1 for k in range(self.top + 1)]  # row of a node in near[k]
        order = np.lexsort((np.arange(n), -self.level))  # upper nodes first: each batch finds its layers built
        at, size = 0, 1
        while at < n:
            self.insert(order[at : at + size], order[:at])
            at, size = at + size, min(max(at + size, 32), 2048)
        self.hub = int(np.argmax(self.level)) if n else 0
        self.strays = self.unreached()

    def unreached(self) -> np.ndarray:
        """Nodes that no walk on the ground from the hub, which every search enters by, arrives at."""
        met = np.zeros(len(self.x), bool)
        now = np.array([self.hub] if len(self.x) else [], np.int64)
        while len(now):
            met[now] = True
            near = np.unique(self.near[0][now])
            now = near[(near >= 0) & ~met[near]]
        return np.flatnonzero(~met)

    def search(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the best `beam` nodes for each query row, best first.

        All rows step in lockstep: each visits its best open nodes, and stops when its beam holds no open one.
        """
        b, table, place = len(q), self.near[level], self.place[level]
        e, wide = entry.shape[1], max(beam, entry.shape[1])
        ids, sims = np.full((b, wide), -1, np.int32), np.full((b, wide), -np.inf, np.float32)
        ids[:, :e] = entry
        sims[:, :e] = np.where(entry >= 0, np.einsum("bed,bd->be", self.x[entry], q), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(sims, order, 1)[:, :beam]
        open_ = ids >= 0
        seen = np.zeros(b * len(self.x), np.uint8)  # not 0 once met, a row's cells after another's
        rows = np.arange(b)
        base = rows * len(self.x)
        for c in range(e):
            seen[base[entry[:, c] >= 0] + entry[entry[:, c] >= 0, c]] = 1
        many = min(AT_ONCE, beam)
        live = rows
        while True:
            live = live[open_[live].any(1)]
            if not len(live):
                return ids, sims
            now = open_[live]
            pick = np.argsort(~now, axis=1, kind="stable")[:, :many]
            going = np.take_along_axis(now, pick, 1)
            r, c = np.nonzero(going)
            node = ids[live[r], pick[r, c]]
            open_[live[r], pick[r, c]] = False
            near = table[place[node]]
            cell = (base[live[r]][:, None] + near).ravel()
            fresh = np.flatnonzero((near.ravel() >= 0) & (seen[cell] == 0))
            turn = np.arange(len(r)) - np.searchsorted(r, r)  # nodes of one step share neighbours: one of them stays
            tag = (turn[:, None] * near.shape[1] + np.arange(1, near.shape[1] + 1)).ravel()[fresh].astype(np.uint8)
            seen[cell[fresh]] = tag
            fresh = fresh[seen[cell[fresh]] == tag]
            got, row = near.ravel()[fresh], r[fresh // near.shape[1]]
            s = np.einsum("kd,kd->k", self.x[got], q[live[row]])
            better = s > sims[live[row], -1]
            got, row, s = got[better], row[better], s[better]
            if not len(got):
                continue
            some, first, size = np.unique(row, return_index=True, return_counts=True)
            width = int(size.max())
            slot = np.arange(len(row)) - np.repeat(first, size)
            line = np.repeat(np.arange(len(some)), size)
            new_ids, new_sims = np.full((len(some), width), -1, np.int32), np.full((len(some), width), -np.inf, np.float32)
            new_ids[line, slot], new_sims[line, slot] = got, s
            at = live[some]
            every = np.concatenate([sims[at], new_sims], 1)
            best = np.argsort(-every, axis=1)[:, :beam]
            sims[at] = np.take_along_axis(every, best, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], new_ids], 1), best, 1)
            open_[at] = np.take_along_axis(np.concatenate([open_[at], new_ids >= 0], 1), best, 1)

    def chosen(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours by the usual heuristic: a candidate nearer to a chosen one than to the query waits; nearest ones fill up."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        b, c = ids.shape
        x = self.x[ids]
        between = np.matmul(x, x.transpose(0, 2, 1))
        picked, count = np.zeros((b, c), bool), np.zeros(b, np.int64)
        worst = np.full((b, c), -np.inf, np.float32)  # similarity to the nearest chosen one
        for k in range(c):
            may = (ids[:, k] >= 0) & (count < most)  # none come after one that is none
            if not may.any():
                break
            take = may & (worst[:, k] < sims[:, k])
            picked[:, k] = take
            count += take
            np.maximum(worst, np.where(take[:, None], between[:, k], -np.inf), out=worst)
        rank = np.where(picked, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.full((b, most), -1, np.int64)
        out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
        return out

    def insert(self, new: np.ndarray, old: np.ndarray) -> None:
        for at in range(0, len(new), 512):
            self.insert_some(new[at : at + 512], np.concatenate([old, new[:at]]))

    def insert_some(self, new: np.ndarray, old: np.ndarray) -> None:
        q = self.x[new]
        entry = np.full((len(new), 1), old[0]) if len(old) else None
        for level in range(self.top, -1, -1):
            mine = np.flatnonzero(self.level[new] >= level)
            if entry is not None and self.level[old[0]] >= level:
                ids, sims = self.search(q, entry, level, BUILD_BEAM if len(mine) else 1)
                entry = ids[np.arange(len(ids)), sims.argmax(1)][:, None]
            else:
                ids, sims = np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf, np.float32)
            if not len(mine):
                continue
            # nodes of the same batch see each other by brute force
            peers = q[mine] @ q[mine].T
            np.fill_diagonal(peers, -np.inf)
            k = min(M0, len(mine) - 1)
            if k > 0:
                top = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                ids_m = np.concatenate([ids[mine], new[mine][top]], 1)
                sims_m = np.concatenate([sims[mine], np.take_along_axis(peers, top, 1)], 1)
            else:
                ids_m, sims_m = ids[mine], sims[mine]
            ids_m = np.where(sims_m > -np.inf, ids_m, -1)
            near = self.chosen(q[mine], ids_m, sims_m, M)
            table, place = self.near[level], self.place[level]
            table[place[new[mine]], :M] = near
            a, b = np.repeat(new[mine], M), near.ravel()
            a, b = a[b >= 0], b[b >= 0]
            self.back_links(level, b, a)

    def back_links(self, level: int, to: np.ndarray, new: np.ndarray) -> None:
        """Nodes `to` learn of nodes `new`; crowded ones choose again."""
        if not len(to):
            return
        sims = np.einsum("kd,kd->k", self.x[to], self.x[new])
        order = np.lexsort((new, -sims, to))
        to, new = to[order], new[order]
        nodes, first, size = np.unique(to, return_index=True, return_counts=True)
        table, place = self.near[level], self.place[level]
        width = table.shape[1]
        rank = np.arange(len(to)) - np.repeat(first, size)
        keep = rank < width
        offered = np.full((len(nodes), width), -1, np.int64)
        offered[np.repeat(np.arange(len(nodes)), size)[keep], rank[keep]] = new[keep]
        have = table[place[nodes]].astype(np.int64)
        twice = (offered[:, :, None] == have[:, None, :]).any(2)
        ids = np.concatenate([have, np.where(twice, -1, offered)], 1)
        for at in range(0, len(nodes), 512):
            part, node = ids[at : at + 512], nodes[at : at + 512]
            q = self.x[node]
            s = np.where(part >= 0, np.einsum("bcd,bd->bc", self.x[part], q), -np.inf).astype(np.float32)
            table[place[node]] = self.chosen(q, part, s, width)

    def sure(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, sims: np.ndarray, least: float) -> np.ndarray:
        """Whether the cosine is >= least: in double precision where single precision cannot tell."""
        sure = sims >= least + EDGE
        near = np.flatnonzero(~sure)
        sure[near] = np.einsum("kd,kd->k", self.exact[nodes[near]], q[rows[near]]) >= least
        return sure

    def compared(self, q: np.ndarray, which: np.ndarray, least: float, nodes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of all (query row, node) pairs with cosine >= least of the query rows `which` and `nodes` (None: all).

        Pairs whose bound by a share of the components is below that are not compared further, which is exact.
        """
        x = self.x if nodes is None else self.x[nodes]
        if not len(x) or not len(which):
            return
        heads = self.heads(x)
        bounds = x if heads is None else bounded(x, heads)
        for at in range(0, len(which), TILE[0]):
            part = which[at : at + TILE[0]]
            own = q[part].astype(np.float32)
            asks = own if heads is None else bounded(own, heads)
            for to in range(0, len(x), TILE[1]):
                sims = asks @ bounds[to : to + TILE[1]].T
                r, c = reaching(sims, least - EDGE)
                if heads is not None and len(r) > sims.size // 8:  # a group
                    sims = own @ x[to : to + TILE[1]].T
                    r, c = reaching(sims, least - EDGE)
                    cos = sims[r, c]
                elif heads is not None:
                    cos = np.einsum("kd,kd->k", own[r], x[to + c])
                    some = cos >= least - EDGE
                    r, c, cos = r[some], c[some], cos[some]
                else:
                    cos = sims[r, c]
                if len(r):
                    rows, node = part[r], to + c if nodes is None else nodes[to + c]
                    sure = self.sure(q, rows, node, cos, least)
                    yield rows[sure], node[sure]

    def heads(self, x: np.ndarray) -> np.ndarray | None:
        """The components of `x` that carry most: enough of them to tell most pairs apart; None: x is as short."""
        many = x.shape[1] * HEAD[0] // HEAD[1]
        return np.sort(np.argsort(-(x[:: max(1, len(x) // 4096)] ** 2).sum(0), kind="stable")[:many]) if many >= HEAD_LEAST else None

    def within(self, q: np.ndarray, own: np.ndarray, least: float, beam: int, checked: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of the (query row, node) pairs with cosine >= least: all pairs of queries whose beams show one or nearly, no pair twice.

        `own` is each query's own node, -1 where another graph holds it; it shows nothing.  `checked`: the other queries are compared too, so no link is missed.
        """
        step = max(1, min(1024, CELLS // max(1, len(self.x))))
        for at in range(0, len(q), step):
            todo = np.arange(at, min(at + step, len(q)))
            x = q[todo].astype(np.float32)
            hub = np.full((len(todo), 1), self.hub)
            entry = hub
            for level in range(self.top, 0, -1):
                entry, _ = self.search(x, entry, level, 1)
            ids, sims = self.search(x, np.concatenate([entry, np.where(entry == hub, -1, hub)], 1), 0, beam)
            shown = ((sims >= least - NEARLY) & (ids != own[todo][:, None])).any(1)
            yield from self.compared(q, todo[shown], least)
            yield from self.compared(q, todo[~shown], least, None if checked else self.strays)


def passing(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, beam: int | None) -> tuple[int | None, int, int]:
    """The first beam, from `beam` on, by which queries with links find their share of them on average (None: none does, compare all), their links and those found."""

    def count(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sum((np.bincount(r[node != own[r]], minlength=len(q)) for r, node in parts), np.zeros(len(q), np.int64))

    total = count(graph.compared(q, np.arange(len(q)), least))
    some = total > 0
    q, own, total = q[some], own[some], total[some]
    while beam is not None and beam < len(graph.x) and beam <= max(BEAM, len(graph.x) // WORTH):
        found = count(graph.within(q, own, least, beam))
        if not len(q) or (found / total).mean() >= RECALL:
            return beam, int(total.sum()), int(found.sum())
        beam *= WIDEN
    return None, int(total.sum()), int(total.sum())


def planted(graph: Graph, keys: np.ndarray, least: float) -> np.ndarray:
    """Queries at the least similarity from a hashed sample of nodes, each towards the next node by hash, as data lie."""
    order = np.argsort(tx.mix(keys.astype(np.int64).view(tx.U64)))
    x, y = graph.exact[order[:PLANTED]], graph.exact[np.roll(order, -1)[:PLANTED]]
    away = y - (y * x).sum(1, keepdims=True) * x
    some = np.abs(away).max(1) > EDGE  # the next node may be a near copy
    return turned(x[some], away[some], least) if some.any() else x[:0]


def turned(x: np.ndarray, away: np.ndarray, least: float) -> np.ndarray:
    """Unit rows at the least similarity from x, in the directions `away`, which are square to x."""
    near = min(1.0, least + EDGE)
    return unit(near * x + np.sqrt(1 - near * near) * unit(away))


def shard_beam(graph: Graph, keys: np.ndarray, least: float) -> int | None:
    """The first beam of a shard that finds the links of planted queries; None: compare all."""
    q = planted(graph, keys, least)
    return passing(graph, q, np.full(len(q), -1), least, BEAM)[0]


def audited(graph: Graph, q: np.ndarray, keys: np.ndarray, own: np.ndarray, least: float, beam: int | None) -> tuple[int | None, int, int]:
    """`passing` from the shard's beam on, by a hashed sample of these queries."""
    rank = np.argsort(tx.mix(keys.astype(np.int64).view(tx.U64)))
    sample = rank[: max(AUDIT_LEAST, len(keys) // AUDIT_EACH)]
    return passing(graph, q[sample], own[sample], least, beam)


def linked(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, beam: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the (query row, node) pairs that link, by a beam that passed the audits and an exact check or, with none, by comparing all.

    `own` is each query's own node, -1 where another graph holds it: that pair needs no search.
    """
    parts = graph.compared(q, np.arange(len(q)), least) if beam is None else graph.within(q, own, least, beam, checked=True)
    for r, node in parts:
        other = node != own[r]
        yield r[other], node[other]
    here = np.flatnonzero(own >= 0)
    yield here, own[here]


def folded(parts: Iterable[tuple[np.ndarray, np.ndarray]], most: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer parts."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, size = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component in the graph of pairs (a, b) over n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def save(folder: str, graph: Graph, ids: np.ndarray, weight: np.ndarray) -> str:
    """Write a graph under a name of its own, so a task that runs again leaves at most a file that nobody names."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}"
    data = io.BytesIO()
    parts = {f"near{k}": x for k, x in enumerate(graph.near)} | {f"place{k}": x.astype(np.int32) for k, x in enumerate(graph.place)}
    np.savez(data, exact=graph.exact, strays=graph.strays, ids=ids, weight=weight, hub=graph.hub, **parts)
    with store.open_output_stream(path) as out:
        out.write(data.getbuffer())
    return path


def load(folder: str, path: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, ids, weights) of a file; such a graph is searched, not built on."""
    with opened(folder)[0].open_input_stream(path) as f:
        data = np.load(io.BytesIO(f.read()))
    graph = Graph.__new__(Graph)
    graph.exact, graph.strays, graph.hub = data["exact"], data["strays"], int(data["hub"])
    graph.x = graph.exact.astype(np.float32)
    graph.near = [data[f"near{k}"] for k in range(sum(n.startswith("near") for n in data.files))]
    graph.place = [data[f"place{k}"] for k in range(len(graph.near))]
    graph.top = len(graph.near) - 1
    return graph, data["ids"], data["weight"]


def rows_each(dim: Column, most: int) -> Column:
    """Rows of a shard of vectors of this length: its graph is held whole by a task."""
    return F.greatest(F.least(F.lit(most), F.floor(F.lit(SHARD_CELLS) / dim)), F.lit(1))


def caps(rows: DataFrame, shard_rows: int, least_shards: int) -> DataFrame:
    """(dim, cap, v): centres of the caps of each length of vectors, rows in the order of a hash."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("total"))
    sizes = sizes.withColumn("want", F.greatest(F.ceil(F.col("total") / rows_each(F.col("dim"), shard_rows)), F.lit(least_shards)))
    share = F.greatest(4 * F.col("want") / F.col("total") * (1 << 30), F.lit(1 << 14))  # more than wanted, so that their order decides
    lot = F.xxhash64(F.lit("cap"), "id")
    some = rows.join(sizes, "dim").where(F.pmod(lot, F.lit(1 << 30)) < share).withColumn("_lot", lot)
    ranked = some.withColumn("cap", F.row_number().over(Window.partitionBy("dim").orderBy("_lot", "id")) - 1)
    return ranked.where(F.col("cap") < F.col("want")).select("dim", "cap", "v")


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre with the largest cosine of each row, the first of equal ones."""
    out, step = np.zeros(len(x), np.int64), max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step] @ centres.T).argmax(1)
    return out


class Shards:
    """What every task knows of the shards: their files, beams, centres and the angle that each reaches."""

    def __init__(self, folder: str, rows: list):
        self.folder, self.rows = folder, {}
        for r in rows:
            self.rows.setdefault(r["dim"], []).append(r)
        self.centres = {d: np.array([r["centre"] for r in some]) for d, some in self.rows.items()}
        self.reach = {d: np.array([r["reach"] for r in some]) for d, some in self.rows.items()}

    def asked(self, dim: int, x: np.ndarray, least: float) -> np.ndarray:
        """(query row, shard): whether a node of the shard may link; if not, the angle to its centre proves it."""
        cos = np.clip(x @ self.centres[dim].T, -1, 1)
        return np.arccos(cos) <= self.reach[dim] + np.arccos(np.clip(least, -1, 1)) + EDGE


def near_vectors(table: DataFrame, least: float = 0.9, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `table` (vec_id, embedding); see `searched`."""
    return searched(table, least, shard_rows, least_shards)[0]


def searched(table: DataFrame, least: float = 0.9, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> tuple[DataFrame, DataFrame]:
    """((vec_id, n_links, component_id, kept) of every row of `table` (vec_id, embedding), audits).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, a component of their
    own.  Vectors of different lengths never link.  Rows that share a vec_id are rows of their own and count as links.
    Audits hold dim, shard, asked (rows that the shard's bound could not answer), links (of audited rows with any, by brute force), found
    (by the beam taken; all where no beam passed) and compared (no beam passed: all pairs of the block and the shard were compared).
    """
    single = table.schema["embedding"].dataType.elementType.simpleString() == "float"  # kept as it is, half as long
    part = "float" if single else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{part}>").alias("v"))
    ok = finite("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("v", F.when(ok, F.transform("v", lambda x: x + F.lit(0.0).cast(part))))
    kinds = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")), "kinds")
    size = kinds.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
    each = 1
    if size["n"] != size["d"]:  # vectors that differ under one vec_id are nodes of their own, in the order of ids
        kinds = written(kinds.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("v")) - 1), "numbered")
        each = kinds.agg(F.max("r")).first()[0] + 1
        kinds = kinds.withColumn("id", F.col("id") * each + F.col("r")).drop("r")
    kinds = kinds.withColumn("dim", F.size("v"))
    spark = table.sparkSession
    folder = new_path(spark, "graphs")
    centres: dict[int, list] = {}
    for r in caps(kinds, shard_rows, least_shards).orderBy("dim", "cap").collect():  # one for `shard_rows` rows
        centres.setdefault(r["dim"], []).append(r["v"])
    heads = {d: unit(np.array(v)) for d, v in centres.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some, x in by_length(batch):
                yield pa.record_batch([*(some.column(c) for c in ("id", "m", "dim", "v")), pa.array(nearest(x, heads[dim]).astype(np.int32))], names=["id", "m", "dim", "v", "cap"])

    placed = written(mapped(kinds.select("id", "m", "dim", "v"), place, f"id long, m long, dim int, v array<{part}>, cap int"), "placed")
    parts = placed.groupBy("dim", "cap").agg(F.ceil(F.count("*") / rows_each(F.col("dim"), shard_rows)).cast("int").alias("parts"))
    sharded = placed.join(parts, ["dim", "cap"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int"))

    def build(key: tuple[int, int, int], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids, x, centre = frame["id"].to_numpy(np.int64), unit(matrix(frame["v"], np.float64)), heads[int(key[0])][int(key[1])]
        graph = Graph(x, ids)
        beam = shard_beam(graph, ids, least)
        reach = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        path = save(folder, graph, ids, frame["m"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [int(key[0])], "cap": [int(key[1])], "part": [int(key[2])], "path": [path], "beam": [beam or 0], "reach": [reach]})

    graphs = written(sharded.select("id", "m", "dim", "v", "cap", "part").groupBy("dim", "cap", "part").applyInPandas(build, "dim int, cap int, part int, path string, beam int, reach double"), "graphs")
    known = Shards(folder, [r.asDict() | {"centre": heads[r["dim"]][r["cap"]]} for r in graphs.orderBy("dim", "cap", "part").collect()])  # a row a shard
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("shard", pa.int32()), ("asked", pa.int64()), ("links", pa.int64()), ("found", pa.int64()), ("compared", pa.bool_())])

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for dim, some, x in by_length(block):
                keys, asked = some.column("id").to_numpy(), known.asked(dim, x, least)
                for shard, row in enumerate(known.rows[dim]):
                    mine = np.flatnonzero(asked[:, shard])
                    if not len(mine):
                        continue
                    got, audit = ask(folder, row, x[mine], keys[mine], least)
                    n = len(got[0])
                    told = {"dim": dim, "shard": shard, "asked": len(mine)} | audit
                    columns = [*(np.append(c, 0) for c in got)]
                    arrays = [pa.array(c, pa.int64(), mask=np.arange(n + 1) == n) for c in columns]
                    arrays += [pa.array([None] * n + [told[f.name]], f.type) for f in list(schema)[3:]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    spread = placed.select("id", "dim", "v").repartition(max(spark.sparkContext.defaultParallelism, -(-size["n"] // BLOCK_ROWS)))
    told = written(mapped(spread, query, "a long, b long, n long, dim int, shard int, asked long, links long, found long, compared boolean"), "links")
    remove(spark, folder)
    found = told.where("a is not null and (n > 0 or a <> b)")
    audits = told.where("a is null").groupBy("dim", "shard").agg(*(F.sum(c).alias(c) for c in ("asked", "links", "found")), F.max("compared").alias("compared"))
    # a vector meets itself in its own shard: m rows, of which one is the row
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.select("a", "b"))
    all_ = kinds.join(links, F.col("id") == F.col("a"), "left").join(joined, F.col("id") == F.col("node"), "left")
    all_ = all_.select(F.col("v").alias("_v"), (F.coalesce("n", "m") - 1).alias("n_links"), F.floor(F.coalesce("component", "id") / F.lit(each)).alias("component_id") if each > 1 else F.coalesce("component", "id").alias("component_id"))
    # the hash first: sorts seldom get to the vectors
    all_, rows = all_.withColumn("_h", F.xxhash64("_v")), rows.withColumn("h", F.xxhash64("v"))
    out = rows.join(all_, (rows["h"] == all_["_h"]) & (rows["v"] == all_["_v"]), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")), audits


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, unit vectors) of a batch with dim and v, each length by itself."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        some = batch.filter(pa.array(dims == dim))
        yield int(dim), some, unit(some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches gathered to about `rows` rows, so that a graph is read for many queries."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def ask(folder: str, row: dict, x: np.ndarray, keys: np.ndarray, least: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict]:
    """((node, smallest node of its component here, links), audit) of queries against one shard; its own row is a link."""
    graph, ids, weight = load(folder, row["path"])
    at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
    own = np.where(ids[at] == keys, at, -1)
    every, back = np.unique(np.concatenate([keys, ids]), return_inverse=True)
    of_row, of_node = back[: len(keys)], back[len(keys) :]
    links, label, all_ = np.zeros(len(every), np.int64), np.arange(len(every)), np.arange(len(every))
    beam, total, met = audited(graph, x, keys, own, least, row["beam"] or None)
    for r, node in folded(linked(graph, x, own, least, beam)):
        links += np.bincount(of_row[r], weights=weight[node], minlength=len(every)).astype(np.int64)
        label = forest(np.concatenate([of_row[r], all_]), np.concatenate([of_node[node], label]), len(every))
    some = (links > 0) | (label != all_)
    return (every[some], every[label[some]], links[some]), {"links": total, "found": met, "compared": beam is None}

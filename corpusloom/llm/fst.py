"""Operator 9: token counts by a tokenizer compiled to deterministic transducers.

Three machines, each finite and deterministic, count the tokens of byte-level BPE without building a token:

1. The *splitter* marks where the tokenizer's pattern opens a pre-token; it is definite (two characters of
   history, three of lookahead), so it is evaluated by shifts.
2. The *merger* is BPE itself.  A state holds, for every vocabulary prefix that ends here, the last token before it and
   its count relative to now; reading a byte gives the next state, and each transition is annotated with how the emitted-token
   count changes.  By the pair property of BPE (a token sequence is the encoding exactly if each neighbouring pair is)
   one last token is possible.  States and transitions are made on first use.
3. The *segmenter* has the states "in a word" and "in white space" and counts words.

Text is cut into chunks of fixed length that run in lockstep.  A chunk's state map is constant from its first pre-token start on,
which resets the merger, so all chunks run that part at once; what lies before depends on the state that the chunk before hands over.  That
state is guessed, from the chunk before entered fresh, as BPE forgets soon; all chunks run from their guesses, and their maps between "entered as
guessed" and "otherwise" compose by a parallel prefix scan, which tells the chunks whose guess was wrong.  Those run again, from what was handed
over, until none is.  So the emitted count of every byte is fixed, and counts of texts are differences of prefix sums, whatever the chunks.  The
segmenter's maps compose by the same scan.  Distinct segments of text run once a worker.  Pre-tokens above LONG_WORD bytes are merged by a heap.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .tokens import ChunkTable, chunks

#: Transitions that a worker keeps at most.
KEPT_ARCS = 4_000_000
#: Bytes of a pre-token from which on it is merged by itself.
LONG_WORD = 1024
#: Bytes of a chunk: of the segmenter, of the merger.
SCAN, CHUNK = 4096, 64


def compose(outer: tuple[np.ndarray, np.ndarray], inner: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map that first runs `inner`, then `outer`; maps are (end state, emitted) by start state, one row a chunk."""
    return np.take_along_axis(outer[0], inner[0], 1), inner[1] + np.take_along_axis(outer[1], inner[0], 1)


def scan(maps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix compositions in log2(chunks) parallel steps."""
    end, out = maps[0].copy(), maps[1].copy()
    step = 1
    while step < len(end):
        end[step:], out[step:] = compose((end[step:], out[step:]), (end[:-step], out[:-step]))
        step *= 2
    return end, out


def segment_counts(data: np.ndarray, length: int = SCAN) -> np.ndarray:
    """Words opened before each chunk of `length` bytes (and in all), by state maps of the segmenter."""
    space = tx.SPACE[data]
    cuts = np.arange(0, len(data), length)
    if not len(cuts):
        return np.zeros(1, np.int64)
    opened = np.zeros(len(data), np.int64)
    opened[1:] = ~space[1:] & space[:-1]
    inside = np.add.reduceat(opened, cuts) - opened[cuts]
    last = np.minimum(cuts + length, len(data)) - 1
    end = np.repeat((~space[last]).astype(np.int64)[:, None], 2, 1)
    emitted = inside[:, None] + np.stack([~space[cuts], np.zeros(len(cuts), bool)], 1)
    return np.concatenate([[0], scan((end, emitted))[1][:, 0]])


class Merger:
    """BPE over bytes as a lazily compiled sequential transducer."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], vocabulary: set[bytes]):
        self.ranks = ranks
        self.tokens: list[bytes] = sorted(vocabulary)
        number = {t: i for i, t in enumerate(self.tokens)}
        self.next: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        for t in self.tokens:
            if self.merge(t) != [t]:
                continue  # no text yields it
            node = 0
            for b in t:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.final.append(-1)
                node = self.next[node][b]
            self.final[node] = number[t]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known = {self.states[0]: 0}
        self.arcs = tx.KeyTable()
        self.to, self.emit = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def pair(self, a: int, b: int) -> bool:
        """May token b follow token a?"""
        if a < 0:
            return True
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT_ARCS:
                self.pairs.clear()
            x, y = self.tokens[a], self.tokens[b]
            got = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return got

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the emitted-token count)."""
        grown, token, count = [], -1, 0
        for node, last, behind in self.states[state]:
            to = self.next[node].get(byte)
            if to is None:
                continue
            grown.append((to, last, behind))
            t = self.final[to]
            if token < 0 and t >= 0 and self.pair(last, t):
                token, count = t, behind + 1
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        made = tuple((n, p, c - count) for n, p, c in grown if self.next[n]) + ((0, token, 0),)
        if made not in self.known:
            self.known[made] = len(self.states)
            self.states.append(made)
        return self.known[made], count

    def moves(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, emitted) of each state << 8 | byte, making transitions not met before."""
        some, back = np.unique(keys, return_inverse=True)
        rows = self.arcs.find(some.view(tx.U64))
        new = np.flatnonzero(rows < 0)
        if len(new):
            got = np.array([self.arc(int(k) >> 8, int(k) & 255) for k in some[new]], np.int64)
            rows[new] = np.arange(self.arcs.size, self.arcs.size + len(new))
            self.arcs.add(some[new].view(tx.U64))
            self.to, self.emit = np.concatenate([self.to, got[:, 0]]), np.concatenate([self.emit, got[:, 1]])
        return self.to[rows][back], self.emit[rows][back]

    def run(self, data: np.ndarray, fresh: np.ndarray, out: np.ndarray, at: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
        """End states of the spans at..ends from `state`, all spans a byte further at each step; `out` gets what each byte emits."""
        at, state, live = at.copy(), state.copy(), np.flatnonzero(at < ends)
        while len(live):
            pos = at[live]
            state[live], out[pos] = self.moves(np.where(fresh[pos], 0, state[live]) << 8 | data[pos])
            at[live] += 1
            live = live[at[live] < ends[live]]
        return state

    def emitted(self, data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """What each byte emits, by the composed state maps of chunks; `starts` are pre-token starts, the first byte's among them."""
        if self.arcs.size > KEPT_ARCS:
            self.clear()
        out, fresh = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
        if not len(data):
            return out
        fresh[starts] = True
        heads = np.arange(0, len(data), chunk)
        ends = np.minimum(heads + chunk, len(data))
        reset = np.append(starts, len(data))[np.searchsorted(starts, heads)]
        constant = reset < ends
        after = np.zeros(len(heads), np.int64)  # state after each chunk whose map is constant
        after[constant] = self.run(data, fresh, out, reset[constant], ends[constant], np.zeros(int(constant.sum()), np.int64))
        waiting = np.flatnonzero(reset > heads)
        if not len(waiting):
            return out
        before = waiting - 1
        first = constant[before]  # the chunk before tells the state; of the others it is guessed from that chunk entered fresh
        guess = after[before]
        guess[~first] = self.run(data, fresh, np.zeros_like(out), heads[before[~first]], ends[before[~first]], np.zeros(int((~first).sum()), np.int64))
        stop, end, todo = np.minimum(reset, ends)[waiting], np.zeros(len(waiting), np.int64), np.arange(len(waiting))
        while len(todo):
            end[todo] = self.run(data, fresh, out, heads[waiting[todo]], stop[todo], guess[todo])
            # a chunk's map between "entered as guessed" (0) and "otherwise" (1): it leaves the next one as guessed, or not; runs begin anew
            follows = np.append(~first[1:], False)
            missed = np.append(end[:-1] != guess[1:], False)
            to = np.stack([follows & missed, follows], 1).astype(np.int64)
            sums = np.add.reduceat(out, np.stack([heads[waiting], stop], 1).ravel()[: 2 * len(waiting) - (stop[-1] >= len(data))])[::2]
            entered = np.concatenate([[0], scan((to, np.stack([sums, np.zeros_like(sums)], 1)))[0][:-1, 0]])
            todo = np.flatnonzero(entered == 1)
            guess[todo] = end[todo - 1]
        return out

    def merges(self, word: bytes) -> int:
        """Tokens of one long word: merges by rank and place from a heap, in time n log n."""
        n, rank = len(word), self.ranks.get
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            a, j = parts[i], after[i]
            if a is None or j >= n or rank((a, parts[j])) != r:
                continue
            parts[i], parts[j], left = a + parts[j], None, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (new, i))
            h = before[i]
            if h >= 0 and (new := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (new, h))
        return left


#: Classes of characters for the splitter.
LETTER, DIGIT, BLANK, SPACE, OTHER = range(5)


def _classes() -> np.ndarray:
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    everything = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"[\t-\r\x20\x85\xa0  -     　]+", SPACE)):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    out[0x20], out[0xD800:0xE000] = BLANK, OTHER
    return out


class Counter(ChunkTable):
    """Token counts of whole texts by a byte-level BPE file."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str):
        super().__init__(seed=12)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre = made["model"], made["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or made["normalizer"] or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files compile")
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 onwards.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        plain = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in made["added_tokens"]]
        special = set(self.special)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = Merger({(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}, {plain(t) for t in model["vocab"] if t not in special})
        self.classes = _classes()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def full(self) -> bool:
        return self.keys.size > KEPT_ARCS

    def clear(self) -> None:
        self.keys, self.value = tx.KeyTable(), np.zeros(0, np.int64)

    def split(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The splitter: bytes of all parts, pre-token starts in them, and each part's offsets."""
        raw = b"".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        offs = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(sizes, out=offs[1:])
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
        point = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        n = len(point)
        kind = self.classes[point]
        fresh = np.zeros(n + 1, bool)
        fresh[np.searchsorted(at, offs[:-1][sizes > 0])] = True
        fresh[n] = True
        white = (kind == BLANK) | (kind == SPACE)
        cut = fresh.copy()
        prev, now = kind[:-1], kind[1:]
        inner = ~fresh[1:n]
        cut[1:n] |= inner & ~white[1:] & ((~white[:-1] & (prev != now)) | (prev == SPACE))
        more = np.zeros(n, bool)
        more[:-1] = ~fresh[1:n] & ~white[1:]  # a word follows at once
        cut[1:n] |= inner & white[1:] & (~white[:-1] | more[1:])
        # 's 't 'm 'd 're 've 'll where a pre-token starts at the apostrophe
        quote = np.flatnonzero((point == 39) & cut[:n])
        if len(quote):
            padded = np.concatenate([point, np.zeros(3, "<u4")])
            block = np.concatenate([fresh, np.ones(2, bool)])
            one, two = padded[quote + 1], padded[quote + 2]
            free = ~block[quote + 1]
            short = free & np.isin(one, [115, 116, 109, 100])
            long = free & ~block[np.minimum(quote + 2, n + 1)] & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            for hit, size in ((short, 2), (long, 3)):
                q = quote[hit]
                cut[q + 1] = False
                cut[np.minimum(q + size, n)] = True
        return data, at[np.flatnonzero(cut[:n])], offs

    def emitted(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What each byte emits; pre-tokens above LONG_WORD bytes, whose states hardly recur, emit their tokens at their first byte."""
        size = np.diff(np.append(starts, len(data)))
        long = np.flatnonzero(size > LONG_WORD)
        if not len(long):
            return self.merger.emitted(data, starts)
        out, keep = np.zeros(len(data), np.int64), np.ones(len(data), bool)
        for k in long:
            out[starts[k]] = self.merger.merges(data[starts[k] : starts[k] + size[k]].tobytes())
            keep[starts[k] : starts[k] + size[k]] = False
        short = np.delete(starts, long)
        out[keep] = self.merger.emitted(data[keep], (np.cumsum(keep) - 1)[short])
        return out

    def learn(self, new: list[bytes]) -> None:
        marks = [s.encode() for s in self.special]
        parts, owner, fixed = [], [], np.zeros(len(new), np.int64)
        for i, x in enumerate(new):
            pieces = [x]
            for mark in marks:
                if mark in x:
                    pieces = [p for y in pieces for p in y.split(mark)]
            fixed[i] = len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(i)
        value = fixed
        if parts:
            data, starts, offs = self.split(parts)
            upto = np.concatenate([[0], np.cumsum(self.emitted(data, starts))])[offs]
            value = value + np.bincount(owner, weights=np.diff(upto), minlength=len(new)).astype(np.int64)
        self.value = np.concatenate([self.value, value])

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each document of a block."""
        starts, ends, own = chunks(data, offs, True)
        row = self.rows(data, starts, ends)
        value = self.value[row]
        upto = np.concatenate([[0], np.cumsum(value)])
        return upto[own[1:]] - upto[own[:-1]]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_bytes, n_tokens) of every row; no shuffle.

    Null and empty texts count 0.  Rows are independent: repeated rows count each, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            tokens, opened = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
            for i, j, d, o in tx.blocks(data, offs):
                tokens[i:j] = counter.count(d, o)
                opened[i:j] = words_before(d, o)
            yield pa.record_batch([batch.column(0), pa.array(opened), pa.array(np.diff(offs)), pa.array(tokens)], names=[key, "n_words", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}`", f"cast(`{text}` as string) as text").mapInArrow(run, f"`{key}` {kind}, n_words long, n_bytes long, n_tokens long")


def words_before(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words of each document from the segmenter's composed chunk maps and the rest of one chunk."""
    base, space = segment_counts(data), tx.SPACE[data]
    opened = np.zeros(len(data) + 1, np.int64)
    opened[1 : len(data)] = ~space[1:] & space[:-1]
    if len(data):
        opened[0] = not space[0]
    inside = np.cumsum(opened)
    chunk = np.minimum(offs // SCAN, len(base) - 1)
    head = np.where(chunk > 0, inside[np.maximum(chunk * SCAN - 1, 0)], 0)
    upto = base[chunk] + np.where(offs > 0, inside[np.maximum(offs - 1, 0)], 0) - head
    joined = np.zeros(len(offs) - 1, np.int64)  # a word that a document boundary splits counts in both
    at = offs[:-1]
    ok = (at > 0) & (at < len(data))
    joined[ok] = ~space[at[ok]] & ~space[at[ok] - 1]
    joined[np.diff(offs) == 0] = 0
    return np.diff(upto) + joined

"""Encoding whole texts with a `tokenizers` file, each distinct chunk once per worker.

Both kinds of file split text by rules that never look across the end of a word:

* byte-level BPE: a chunk is a white-space run with the word after it (or the run that ends a text);
* word BPE that drops white space: a chunk is a word.

So a text's ids are its chunks' ids in order.  Documents holding white space outside ASCII are one chunk,
as the pattern may then split differently.  A worker keeps the ids of the chunks it has met, up to a bound.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import text as tx

ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Chunks and ids a worker keeps at most before it starts anew.
KEPT_CHUNKS, KEPT_IDS = 3_000_000, 24_000_000
#: Longer chunks are encoded but not kept.
KEPT_BYTES = 64


def chunks(data: np.ndarray, offs: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all chunks, and each document's range of chunks."""
    starts, ends, _ = tx.words(data, offs)
    odd = np.unique(np.searchsorted(offs, [m.start() for m in ODD_SPACE.finditer(data)], "right") - 1)
    if spaces:
        mark = np.zeros(len(data) + 1, bool)
        mark[offs] = mark[ends] = True
        cuts = np.flatnonzero(mark)
        if len(odd):
            doc = np.searchsorted(offs, cuts, "right") - 1
            cuts = cuts[~(np.isin(doc, odd) & (cuts != offs[np.minimum(doc, len(offs) - 1)]))]
        starts, ends = cuts[:-1], cuts[1:]
    elif len(odd):
        doc = np.searchsorted(offs, starts, "right") - 1
        keep = ~np.isin(doc, odd)
        starts, ends = np.concatenate([starts[keep], offs[odd]]), np.concatenate([ends[keep], offs[odd + 1]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offs)


class ChunkTable:
    """What a worker knows of chunks: `learn` gives the arrays of new ones; `value` rows follow KeyTable's."""

    def __init__(self, seed: int):
        self.seed, self.keys = seed, tx.KeyTable()

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each span, learning spans not met before."""
        keys, first, back = np.unique(tx.hash_spans(data, starts, ends, self.seed), return_index=True, return_inverse=True)
        if self.full():
            self.clear()
        at = self.keys.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self.learn([raw[i:j] for i, j in zip(s, e, strict=True)])
            at[new] = np.arange(self.keys.size, self.keys.size + len(new))
            self.keys.add(keys[new])
        return at[back]


class Encoder(ChunkTable):
    """ids of whole texts by a tokenizer file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(seed=11)
        self.tokenizer = Tokenizer.from_file(path)
        first, second = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" a", "a"))
        self.spaces = first != second
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each file and worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def full(self) -> bool:
        return self.keys.size > KEPT_CHUNKS or len(self.flat) > KEPT_IDS

    def clear(self) -> None:
        self.keys = tx.KeyTable()
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of a block and each document's range of them."""
        starts, ends, own = chunks(data, offs, self.spaces)
        row = self.rows(data, starts, ends)
        size = self.size[row]
        ids = self.flat[tx.ranges(self.at[row], size)]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        return ids, upto[own]

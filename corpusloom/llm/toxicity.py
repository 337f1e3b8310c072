"""Operator 2: a convolutional text classifier in numpy.

Words (A-Z lowered, edge punctuation dropped) are embedded by hash tables: two independent ones of the whole word, one each of
its first four and six bytes, so inflected and compound forms share strength.  Filters of several widths
slide over the whole text, the maximum over all positions is pooled, and a logistic layer gives the score.

Training starts from random numbers; nothing of the labels enters but through gradients.  It sees a bounded sample of labelled
documents, hashed to four 16-bit buckets a word where the texts are read, and runs in one executor task, so neither texts nor
words reach the driver.  Early epochs pool by a soft maximum, through which every position learns; the last ones by the maximum itself.

Calibration uses every labelled document of a fold that training does not see: their outputs are counted in
bins, slope and shift of the score are fitted on the counts, and each language gets the cut that errs least.
Labels, language, source and ids never enter a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import mapped, written

BUCKET_BITS, TABLES, DIM, FILTERS, WIDTHS = 16, 4, 4, 8, (1, 2, 3)
#: Bytes of the two prefixes.
PREFIXES = (4, 6)
#: Bounds of the training sample: documents of each class, words of a document that is taken, words in all.
SAMPLE, LONGEST, SAMPLE_WORDS = {1: 1500, 0: 2500}, 2000, 1_500_000
#: Of five folds by crc32(doc_id): never seen, calibration; the others train.
HELD_OUT, CALIBRATION = 0, 1
#: Sharpness of the soft maximum, epoch by epoch; None: the maximum itself.
EPOCHS: tuple[float | None, ...] = (1.0, 2.0, 4.0, None)
#: Epochs repeat until training takes so many steps.
LEAST_STEPS = 160
#: Width of a bin of outputs, and their range.
BIN, RANGE = 0.1, 40.0
EDGE = np.zeros(256, bool)
EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (uint16, one column a table) of the words of a block, and each document's range; words of punctuation only stay whole."""
    data = tx.LOWER[data]
    starts, ends, own = tx.words(data, offs)
    plain = np.flatnonzero(~EDGE[data])
    if len(plain) and len(starts):
        first, last = np.searchsorted(plain, starts), np.searchsorted(plain, ends) - 1
        some = first <= last
        starts = np.where(some, plain[np.minimum(first, len(plain) - 1)], starts)
        ends = np.where(some, plain[np.maximum(last, 0)] + 1, ends)
    whole, *prefixes = tx.hash_spans(data, starts, ends, 41), *(tx.hash_spans(data, starts, np.minimum(ends, starts + n), 41 + n) for n in PREFIXES)
    return np.stack([x.astype(np.uint16) for x in (whole, whole >> tx.U64(32), *prefixes)], 1), own


def shifted(parts: np.ndarray, width: int, at: int, ends: np.ndarray) -> np.ndarray:
    """Responses of one width from those of its words; words past a document's end are zero."""
    total = parts[:, at : at + FILTERS].copy()
    pos = np.arange(len(parts))
    for o in range(1, width):
        inside = (pos[:-o] + o < ends[:-o])[:, None] if len(pos) > o else np.zeros((0, 1), bool)
        total[: len(inside)] += parts[o:, at + o * FILTERS : at + (o + 1) * FILTERS] * inside
    return total


@dataclass
class Model:
    """tables: TABLES x buckets x DIM; filters: TABLES * DIM x sum(WIDTHS) * FILTERS, by (width, offset, filter); one logistic layer."""

    tables: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def random(cls, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        some = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        pooled = len(WIDTHS) * FILTERS
        return cls(some(0.1, TABLES, 1 << BUCKET_BITS, DIM), some(0.3, TABLES * DIM, sum(WIDTHS) * FILTERS), np.zeros(pooled, np.float32), some(0.3, pooled), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.filters, self.bias, self.out, self.out_bias]

    def responses(self) -> list[np.ndarray]:
        """The response of every bucket to every filter: gathers replace products when scoring."""
        return [self.tables[t] @ self.filters[t * DIM : (t + 1) * DIM] for t in range(TABLES)]

    def outputs(self, words: np.ndarray, own: np.ndarray, responses: list[np.ndarray] | None = None) -> np.ndarray:
        """The output before the sigmoid for each document of a block."""
        responses = responses or self.responses()
        pool = np.full((len(own) - 1, len(WIDTHS) * FILTERS), -1e9, np.float32)  # a text without words shows nothing
        full = np.flatnonzero(np.diff(own) > 0)
        if len(full):
            parts = responses[0][words[:, 0]]
            for t in range(1, TABLES):
                parts += responses[t][words[:, t]]
            ends, at = np.repeat(own[1:], np.diff(own)), 0
            for k, w in enumerate(WIDTHS):
                pool[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(shifted(parts, w, at, ends), own[:-1][full])
                at += w * FILTERS
        z = np.maximum(pool + self.bias, 0) @ self.out + self.out_bias[0]
        return np.clip(z.astype(np.float64), -RANGE, RANGE)

    def gradients(self, words: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray, sharp: float | None) -> list[np.ndarray]:
        """Of the weighted mean logistic loss over nonempty documents."""
        x = np.concatenate([self.tables[t][words[:, t]] for t in range(TABLES)], 1)
        parts = x @ self.filters
        heads, sizes = own[:-1], np.diff(own)
        row, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(own[1:], sizes)
        pool, shares, at = [], [], 0
        for w in WIDTHS:
            z = shifted(parts, w, at, ends)
            top = np.maximum.reduceat(z, heads)
            if sharp is None:
                share = (z == top[row]).astype(np.float32)
            else:
                share = np.exp(sharp * (z - top[row]))
            total = np.add.reduceat(share, heads)
            share /= total[row]
            pool.append(top if sharp is None else np.add.reduceat(share * z, heads))
            shares.append(share)
            at += w * FILTERS
        pooled = np.concatenate(pool, 1)
        hidden = np.maximum(pooled + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias[0], -30, 30)))
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        down = g[:, None] * self.out * (hidden > 0)
        back, at = np.zeros_like(parts), 0
        for k, w in enumerate(WIDTHS):
            d = shares[k] * down[:, k * FILTERS : (k + 1) * FILTERS][row]
            back[:, at : at + FILTERS] = d
            for o in range(1, w):
                inside = np.arange(len(d) - o) + o < ends[: len(d) - o] if len(d) > o else np.zeros(0, bool)
                back[o:, at + o * FILTERS : at + (o + 1) * FILTERS] = d[: len(inside)] * inside[:, None]
            at += w * FILTERS
        moved = back @ self.filters.T
        tables = np.stack([
            np.stack([np.bincount(words[:, t], weights=moved[:, t * DIM + d], minlength=1 << BUCKET_BITS) for d in range(DIM)], 1) for t in range(TABLES)
        ]).astype(np.float32)
        return [tables, x.T @ back, down.sum(0), g @ hidden, np.array([g.sum()], np.float32)]


def train(docs: list[tuple[np.ndarray, int]], epochs: tuple[float | None, ...] = EPOCHS, rate: float = 0.02, seed: int = 5, batch: int = 64) -> Model:
    """A model from random numbers by Adam on the logistic loss, classes in balance; `docs` are (buckets, label)."""
    model, rng = Model.random(seed), np.random.default_rng(seed)
    docs = [(w, y) for w, y in docs if len(w)]
    ones = sum(y for _, y in docs)
    if not 0 < ones < len(docs):
        return model
    weights = {1: len(docs) / (2 * ones), 0: len(docs) / (2 * (len(docs) - ones))}
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    again = -(-LEAST_STEPS // max(1, len(epochs) * -(-len(docs) // batch)))
    schedule = [sharp for sharp in epochs for _ in range(again)]
    for n, sharp in enumerate(schedule):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = [docs[i] for i in order[at : at + batch]]
            own = np.concatenate([[0], np.cumsum([len(w) for w, _ in some])])
            y = np.array([y for _, y in some], np.float32)
            grads = model.gradients(np.concatenate([w for w, _ in some]), own, y, np.array([weights[k] for _, k in some], np.float32), sharp)
            step += 1
            pace = rate * (1 - 0.8 * n / len(schedule)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * m / (np.sqrt(v) + 1e-8)
    return model


def without_copies(docs: list[tuple]) -> list[tuple]:
    """Near copies would make their words look typical: of documents that share one of two minhashes of 5-word runs, the first stays."""
    seen: set[tuple[int, int]] = set()
    out = []
    for doc in docs:
        words = doc[0][:, 0].astype(tx.U64) << tx.U64(16) | doc[0][:, 1].astype(tx.U64)
        runs = tx.Rolling(tx.mix(words), 0x5851F42D4C957F2D).windows(min(5, max(1, len(words))))
        marks = {(k, int(tx.mix(runs ^ tx.U64(k)).min())) for k in (101, 202)} if len(runs) else set()
        if not marks & seen:
            out.append(doc)
        seen |= marks
    return out


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def known(labels: DataFrame) -> DataFrame:
    """(_id, _y): one row for each labelled document; of labels that differ, 1 holds."""
    some = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    return some.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))


def train_task(frame: pd.DataFrame) -> pd.DataFrame:
    """The model of the sample's rows (h, y, words), in an order that the rows themselves fix."""
    frame = frame.sort_values(["h", "words"])
    docs = [(np.frombuffer(w, np.uint16).reshape(-1, TABLES), int(y)) for w, y in zip(frame["words"], frame["y"], strict=True)]
    return pd.DataFrame({"model": [pickle.dumps(train(without_copies(docs)), protocol=5)]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled documents, chosen by hash of their ids; without labels, of random numbers.

    Ids are chosen from the labels alone and number at most sum(SAMPLE), so they are broadcast to the scan of the texts.
    """
    some = known(labels).where(~fold("_id").isin(HELD_OUT, CALIBRATION)).withColumn("h", F.xxhash64(F.lit(3), "_id"))
    picked = some.where("_y = 1").orderBy("h").limit(SAMPLE[1]).union(some.where("_y = 0").orderBy("h").limit(SAMPLE[0]))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tx.string_column(batch, "text")
            for i, j, d, o in tx.blocks(data, offs):
                words, own = word_buckets(d, o)
                sizes = np.diff(own)
                taken = [words[a:b].tobytes() if b - a <= LONGEST else None for a, b in zip(own, own[1:], strict=False)]
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sizes), pa.array(taken, pa.binary())], names=["h", "y", "n", "words"])

    rows = mapped(texts.select("h", F.col("_y").alias("y"), "text"), hashed, "h long, y int, n long, words binary").where("words is not null")
    upto = F.sum("n").over(Window.orderBy("h", "n", "words"))  # over the bounded sample only
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_WORDS).select("h", "y", "words")
    got = rows.groupBy().applyInPandas(train_task, "model binary").collect()  # one model of a fixed size
    return pickle.loads(got[0]["model"]) if got else Model.random()


#: Bytes of text whose responses are held at once: a word has some 400 bytes of them.
OUTPUT_BYTES = 1 << 18


def with_output(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` but _text, and _z, the output for column _text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: tables of 2**16 buckets
    names = [c for c in docs.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = sent.value
        responses = own_model.responses()
        for batch in batches:
            data, offs = tx.string_column(batch, "_text")
            out = np.zeros(len(offs) - 1)
            for i, j, d, o in tx.blocks(data, offs, OUTPUT_BYTES):
                out[i:j] = own_model.outputs(*word_buckets(d, o), responses)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out)], names=[*names, "_z"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names) + "_z double"
    return mapped(docs, run, schema)


@dataclass(frozen=True)
class Calibration:
    """score = sigmoid(slope * output + shift); cuts: (_lang, _cut), the output from which a language's documents are rejected."""

    slope: float
    shift: float
    cuts: DataFrame

    @property
    def cut(self) -> float:
        return -self.shift / self.slope


def logistic(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the smoothed logistic fit to counts of both classes at outputs z, by Newton steps; (1, 0) where a class is missing."""
    a, b = ones.sum(), zeros.sum()
    if not a or not b:
        return 1.0, 0.0
    n, t = ones + zeros, (ones * (a + 1) / (a + 2) + zeros / (b + 2)) / np.maximum(ones + zeros, 1)
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((n * (np.logaddexp(0, s) - t * s)).sum() + 1e-3 * w[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (n * (p - t)) + [2e-3 * w[0], 0]
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        move, pace = np.linalg.solve(h, g), 1.0
        while pace > 1e-6 and loss(w - pace * move) > loss(w):
            pace /= 2
        w = w - pace * move
        if np.abs(pace * move).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 1e-3 else (1.0, 0.0)


def best_cut(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The output from which calling documents 1 errs least, in the middle of the bins that err so; z ascends."""
    wrong = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum(zeros[::-1])[::-1], [0]])
    edge = np.concatenate([[z[0] - BIN], (z[1:] + z[:-1]) / 2, [z[-1] + BIN]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edge[best[len(best) // 2]])


#: A language needs so many labelled documents of each class for a cut of its own.
OWN_CUT = 3


def calibrate(docs: DataFrame, labels: DataFrame, model: Model) -> Calibration:
    """From all labelled documents of the calibration fold; languages that lack a class there have no cut of their own."""
    some = known(labels).where(fold("_id") == CALIBRATION)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("_text"))
    met = with_output(texts.where(fold("_id") == CALIBRATION).join(some, "_id"), model)
    bins = met.groupBy("_lang", F.round(F.col("_z") / BIN).cast("int").alias("bin")).agg(F.sum("_y").alias("ones"), F.sum(1 - F.col("_y")).alias("zeros"))
    bins = written(bins, "outputs")
    every = bins.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).orderBy("bin").toPandas()  # 2 * RANGE / BIN rows at most

    def own_cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        a, b = frame["ones"].to_numpy(np.float64), frame["zeros"].to_numpy(np.float64)
        cut = [best_cut(frame["bin"].to_numpy(np.float64) * BIN, a, b)] if min(a.sum(), b.sum()) >= OWN_CUT else []
        return pd.DataFrame({"_lang": frame["_lang"].iloc[: len(cut)], "_cut": cut})

    cuts = written(bins.where("_lang is not null").groupBy("_lang").applyInPandas(own_cut, "_lang string, _cut double"), "cuts")
    slope, shift = logistic(every["bin"].to_numpy(np.float64) * BIN, every["ones"].to_numpy(np.float64), every["zeros"].to_numpy(np.float64))
    return Calibration(slope, shift, cuts)


#: Columns that `score` adds; others of these names in its input give way.
ADDED = ("held_out", "score", "predicted", "threshold", "rejected")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs` with held_out, score, predicted, threshold and rejected; columns of these names in `docs` give way.

    Null and empty texts are scored as texts without words.  Without labels of both classes the model stays at its start and
    the score says nothing.  Repeated rows score alike.  held_out is null for a null doc_id.  A missing or null lang has the
    general threshold 0.5.  An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ADDED]
    own = docs.select(*names) if "lang" in names else docs.select(*names, F.lit(None).cast("string").alias("lang"))
    model = fit(own, labels)
    found = calibrate(own, labels, model)
    plain = [f"c{i}" for i in range(len(names))]  # so that no column of `docs` clashes with one of ours
    renamed = own.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)), F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("_of"), F.col("text").cast("string").alias("_text"))
    scored = with_output(renamed, model)
    scored = scored.join(found.cuts, F.col("_of") == F.col("_lang"), "left")  # its size is known: a written table
    sigmoid = lambda z: 1 / (1 + F.exp(-(z * F.lit(found.slope) + F.lit(found.shift))))
    held, score_, least = fold("_id") == HELD_OUT, sigmoid(F.col("_z")), F.coalesce(sigmoid(F.col("_cut")), F.lit(0.5))
    rejected = F.col("_z") >= F.coalesce("_cut", F.lit(found.cut))
    added = (held, score_, (score_ >= 0.5).cast("int"), least, rejected)
    return scored.select(*(F.col(p).alias(c) for c, p in zip(names, plain, strict=True)), *(x.alias(c) for c, x in zip(ADDED, added, strict=True)))

"""Operator 12: conversation structure repair by a min-plus matrix scan.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Four states say what the output so far ends with: nothing, the system
turn, a user turn, an assistant turn.  Every turn becomes a 4 x 4 matrix over (cost, audit) elements, from the state before it to the
state behind it: keep, rerole or delete it, after any inserts (insert closure).  Elements add by the least cost, then the least audit in
ASCII order, and multiply by the sum of costs and the audits joined; of two audits over the same turns neither begins the other at equal cost, so
order survives joining and the product is associative.

Turns are range-partitioned by (conversation, turn, role, text) and numbered, so a conversation of any length lies over as many partitions as
it needs.  Runs of at most 2**CHUNK_BITS turns become one element each, and elements of a conversation are multiplied FAN at a time, level by
level.  With the matrix rides what else adds up over runs: faults, breaks between roles, turn numbers.  The best audit then goes
to the turns as one more row in front of them, and they are repaired in one pass in order, holding one row at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, mapped, written

#: Turns of an element at most (as a power of two), and elements that one product takes.
CHUNK_BITS, FAN = 12, 64
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits K, R, D and I, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Kinds of a turn by the initial of its role (s, u, a, another): sound, truncated, or blank or repeated, which must go.
SOUND, TRUNCATED, GONE = "suao", "SUAO", "0123"
STEPS = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),), "o": ()}
LEGAL = {"su", "ua", "au"}

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def best(found: list[Element]) -> Element:
    return min((x for x in found if x is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: least cost, then least audit."""
    out = []
    for row in a:
        have = [(k, x) for k, x in enumerate(row) if x is not None]
        out.append(tuple(best([(x[0] + y[0], x[1] + y[1]) for k, x in have if (y := b[k][j]) is not None]) for j in range(4)))
    return tuple(out)


def matrix(entries: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


def closure() -> Matrix:
    """Any inserts: the closure of one insert, whose cycles only cost."""
    one = matrix({(i, i): (0, "") for i in range(4)} | {step: (INSERT, "I") for x in "ua" for step in STEPS[x]})
    return times(one, times(one, one))


INSERTS = closure()


@lru_cache(maxsize=1 << 16)
def product(kinds: str) -> Matrix:
    """The matrix of a run of turns, halved until it is one turn; short runs are remembered."""
    if len(kinds) > 1:
        half = 1 << (len(kinds) - 1).bit_length() - 1
        part = product if half <= 32 else product.__wrapped__
        return times(part(kinds[:half]), part(kinds[half:]))
    entries: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if kinds not in GONE:
        initial, cut = kinds.lower(), CUT * (kinds in TRUNCATED)
        ways = [(step, (KEEP + cut, "K")) for step in STEPS[initial]] + [(step, (REROLE + cut, "R")) for x in "ua" for step in STEPS[x]]
        for step, way in ways:
            entries[step] = best([entries.get(step), way])
    return times(INSERTS, matrix(entries))


def initial_of(kind: str) -> str:
    return kind.lower() if kind not in GONE else SOUND[GONE.index(kind)]


#: Fields of an element beside its key; costs and audits hold the 16 entries of the matrix.
FIELDS = ("first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns", "costs", "audits")
SCHEMA = "first string, last string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long, costs array<long>, audits array<string>"


def flat(m: Matrix) -> tuple[list, list]:
    every = list(chain.from_iterable(m))
    return [x and x[0] for x in every], [x and x[1] for x in every]


def square(costs: list, audits: list) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


def joined(a: dict, b: dict) -> dict:
    """The element of one run followed by another."""
    low, high = (x for x in (a["low"], b["low"]) if x is not None), (x for x in (b["high"], a["high"]) if x is not None)
    costs, audits = flat(times(square(a["costs"], a["audits"]), square(b["costs"], b["audits"])))
    out = {k: a[k] + b[k] for k in ("illegal", "blank", "duplicate", "truncated", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]  # a turn number that both runs hold
    return out | {"first": a["first"], "last": b["last"], "low": next(low, None), "high": next(high, None), "costs": costs, "audits": audits}


def reduced(parts: list[dict]) -> dict:
    """The parts in order as one, by halves."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def fault_kind() -> Column:
    """The letter of a turn from the columns initial, blank, duplicate and truncated."""
    at = F.position(F.col("initial"), F.lit(SOUND))
    letter = lambda s: F.substring(F.lit(s), at, F.lit(1))
    return F.when(F.col("blank") | F.col("duplicate"), letter(GONE)).when(F.col("truncated"), letter(TRUNCATED)).otherwise(letter(SOUND))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, text, pos), written in order: pos ascends by conversation, turn (nulls first), role and text; null roles and texts are one space."""
    clean = rows.select(F.col(key).alias("_key"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = ("_key", "turn", "role", "text", "_salt")  # equal rows are interchangeable and may lie in several partitions
    dealt = clean.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.drop("_salt").withColumn("pos", F.monotonically_increasing_id()), "turns", large=True)


def marked(turns: DataFrame) -> DataFrame:
    """(_key, pos, turn, kind, fault) of every turn: its first fault of blank, duplicate and truncated, or an empty string.

    Which (role, text) a conversation repeats is a grouped minimum over a digest of the text, written before the join, so one text in many turns is
    split as a skewed key.
    """
    first, seen = F.substring("role", 1, 1), ["_key", "role", "digest"]
    found = turns.select(
        "_key", "pos", "turn", "role", F.sha2("text", 256).alias("digest"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"), (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("truncated"),
    )
    earliest = written(gathered(found.where("not blank").groupBy(*seen).agg(F.min("pos").alias("_pos"), F.count("*").alias("n")).where("n > 1").drop("n")), "repeated-turns")
    on = found["_key"].eqNullSafe(earliest["_key"]) & (found["role"] == earliest["role"]) & (found["digest"] == earliest["digest"])
    known = found.join(earliest, on, "left").select(*(found[c] for c in found.columns), (~F.col("blank") & F.coalesce(F.col("pos") > F.col("_pos"), F.lit(False))).alias("duplicate"))
    fault = F.when(F.col("blank"), "blank").when(F.col("duplicate"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    return known.select("_key", "pos", "turn", fault_kind().alias("kind"), fault.alias("fault"))


def elements(faults: DataFrame) -> DataFrame:
    """(_key, seq, fields): one element for each run of at most 2**CHUNK_BITS turns of a conversation."""
    one = F.struct("pos", "kind", "turn")
    count = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    runs = faults.groupBy("_key", F.shiftright("pos", CHUNK_BITS).alias("seq")).agg(F.sort_array(F.collect_list(one)).alias("rows"), *map(count, ("blank", "duplicate", "truncated")), F.min("turn").alias("low"), F.max("turn").alias("high"))
    turns = F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())))
    runs = runs.select("_key", "seq", F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"), "blank", "duplicate", "truncated", "low", "high", turns.cast("long").alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {k: [] for k in ("first", "last", "illegal", "costs", "audits")}
            for kinds in batch.column(2).to_pylist():
                names = "".join(map(initial_of, kinds))
                costs, audits = flat(product(kinds) if len(kinds) <= 32 else product.__wrapped__(kinds))
                row = (names[0], names[-1], sum(names[i : i + 2] not in LEGAL for i in range(len(names) - 1)), costs, audits)
                for k, v in zip(made, row, strict=True):
                    made[k].append(v)
            kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "kinds"}
            types = {"first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
            columns = kept | {k: pa.array(v, types[k]) for k, v in made.items()}
            yield pa.record_batch([columns[n] for n in ("_key", "seq", *FIELDS)], names=["_key", "seq", *FIELDS])

    return mapped(runs, run, f"_key {faults.schema['_key'].dataType.simpleString()}, seq long, {SCHEMA}")


def wholes(parts: DataFrame) -> DataFrame:
    """One element a conversation: products of FAN elements that follow each other, level by level, until each has one."""
    kind = parts.schema["_key"].dataType.simpleString()
    some = Window.partitionBy("_key")  # runs, not turns: a conversation of 10**9 turns has 250,000
    level = written(gathered(parts.withColumns({"_n": F.count("*").over(some), "seq": (F.row_number().over(some.orderBy("seq")) - 1).cast("long")})), "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [reduced(r["parts"]) | {"_key": r["_key"], "seq": r["seq"]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    long, text = pa.int64(), pa.string()
    types = {"first": text, "last": text, "costs": pa.list_(long), "audits": pa.list_(text)}
    schema = pa.schema([("_key", level.limit(0).toArrow().schema.field("_key").type), ("seq", long), *((f, types.get(f, long)) for f in FIELDS)])
    single = level.where("_n = 1").select("_key", *FIELDS)
    left, most = level.where("_n > 1").drop("_n"), level.agg(F.max("_n")).first()[0] or 1
    while most > 1:
        grouped = left.groupBy("_key", F.floor(F.col("seq") / FAN).alias("seq")).agg(F.sort_array(F.collect_list(F.struct("seq", *FIELDS))).alias("parts"))
        left, most = written(mapped(gathered(grouped), run, f"_key {kind}, seq long, {SCHEMA}"), "elements"), -(-most // FAN)
    return single.unionByName(left.select("_key", *FIELDS))


def answers(whole: DataFrame) -> DataFrame:
    """(_key, gaps, blank, duplicate, truncated, illegal, cost, audit): the best way from nothing to nothing or an assistant turn."""
    counts = ("blank", "duplicate", "truncated", "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("costs", "audits"))
            last = [best([(r := times(square(c, a)[:1], INSERTS)[0])[NOTHING], r[ASSISTANT]]) for c, a in zip(costs, audits, strict=True)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("_key", "low", "high", "turns", *counts)]
            yield pa.record_batch([*kept, pa.array([x[0] for x in last], pa.int64()), pa.array([x[1] for x in last], pa.string())], names=["_key", "low", "high", "turns", *counts, "cost", "audit"])

    kind = whole.schema["_key"].dataType.simpleString()
    found = mapped(whole, run, f"_key {kind}, low long, high long, turns long, {', '.join(f'{c} long' for c in counts)}, cost long, audit string")
    return found.select("_key", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), *counts, "cost", "audit")


def repaired(turns: DataFrame, answer: DataFrame) -> DataFrame:
    """(_key, seq, role, text, edit): the repaired turns, each conversation's in one partition and in order.

    A conversation's audit comes as the row before its turns; only the row at hand is held.
    """
    none = F.lit(None).cast("string")
    rows = turns.select("_key", "pos", "role", "text", none.alias("audit")).unionByName(answer.select("_key", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, seq, system = iter(()), 0, False

        def inserted(seq: int, edit: str, role: str | None, text: str) -> tuple:
            return seq, role or ("user", "assistant")[(seq - system) % 2], text, edit

        for batch in batches:
            keys, rest = batch.column(0), [batch.column(i).to_pylist() for i in (2, 3, 4)]
            at, out = [], []
            for i, (role, text, audit) in enumerate(zip(*rest, strict=True)):
                if audit is not None:  # inserts go before their turn, the last ones behind the last turn
                    edits, seq, system = iter(re.findall(r"I*[KRD](?:I+$)?|^I+$", audit)), 0, False
                    continue
                for e in next(edits):
                    if e == "D":
                        continue
                    if seq == 0:
                        system = e == "K" and role[:1] == "s"
                    made = inserted(seq, e, role if e == "K" else None, "" if e == "I" else text)
                    seq += 1
                    at.append(i)
                    out.append(made)
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([keys.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["_key", "seq", "role", "text", "edit"])

    return mapped(rows, run, f"_key {turns.schema['_key'].dataType.simpleString()}, seq long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """(_key, repaired_sha256) of what `repaired` gives: role:text, newline-joined, hashed as the rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([key, pa.array([state.hexdigest()])], names=["_key", "repaired_sha256"])

        for batch in batches:
            keys, (seq, role, text) = batch.column(0), [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for i, (n, r, x) in enumerate(zip(seq, role, text, strict=True)):
                if n == 0:
                    if state:
                        yield done()
                    state, key = hashlib.sha256(), keys.slice(i, 1)
                state.update(f"{chr(10) * (n > 0)}{r}:{x}".encode())
        if state:
            yield done()

    return mapped(rows, run, f"_key {rows.schema['_key'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(answer, turns): (key, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with turns, and its repaired turns.

    `rows` has key, turn, role and text; other columns are ignored.  Turns are taken by turn (nulls first), role and text; null roles and
    texts are one space; a null key is one conversation.  Repeated rows are duplicates; an empty table gives empty tables.  The audit is
    as long as the conversation has turns, a byte each, so a conversation of 10**9 turns needs rows of some GB.
    """
    turns = numbered(rows, key)
    answer = written(gathered(answers(wholes(elements(marked(turns))))), "answers")
    return answer.withColumnRenamed("_key", key), repaired(turns, answer).withColumnRenamed("_key", key)


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text) with faults by rule: crc32 of `key:turn` modulo 20 drops (0), empties (1), cuts the ends of sentences (2), repeats (3), or makes it the user's (4)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.pmod(F.crc32(F.concat(told(key), F.lit(":"), told("turn"))), F.lit(20))
    text = F.when(rule == 1, "").when(rule == 2, F.regexp_replace(told("text"), r"[.!?]", "")).otherwise(told("text"))
    times_ = F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1)
    copies = rows.select(key, "turn", F.when(rule == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times_)).alias("_copy"))
    return copies.drop("_copy")


def report(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every conversation of `rows` after damage and repair: its answer and the digest of its repaired turns; without turns zeros and empty strings."""
    answer, turns = repair(damaged(rows, key), key)
    told = digests(turns.withColumnRenamed(key, "_key"))
    every = rows.select(F.col(key).alias("_every")).distinct()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined_ = every.join(answer, every["_every"].eqNullSafe(answer[key]), "left").drop(key)
    joined_ = joined_.join(told, joined_["_every"].eqNullSafe(told["_key"]), "left")
    return joined_.select(
        F.col("_every").alias(key), *(F.coalesce(c, F.lit(0)).alias(c) for c in names), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )

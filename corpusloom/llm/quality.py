"""Operator 13: quality rules as a short-circuit cascade, in DataFrame functions only.

`features` gives the counts that reports want of every document.  `Rule`s judge one document each; `estimated` runs every rule
alone over a bounded sample, takes the time it needs and which rows it rejects, and orders the rules: first the one with most
rejections per second among the rows that no earlier rule rejects, then the next by what is left.  `cascade` nests the rules in
that order in one conditional expression, so a row that a rule rejects never pays for those behind it: their words and lines are
not even made.  The verdict is a conjunction, so the order changes the time only.

Nothing is shuffled: every document is judged in its own row, so a source or key with a third of all rows is no hot spot.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

SPACES, A_WORD = " \t\n\x0b\f\r", r"[^\x20\x09-\x0D]"
#: Documents of the sample that orders the rules, about; it changes no result.
SAMPLE = 2000
#: Windows of this many words count as repeated.
WINDOW = 3
#: Low bits of a packed window hash that hold its place.
PLACE_BITS = 24


@dataclass(frozen=True)
class Rule:
    """`rejects` is a boolean column over text and the columns of `features`; null rejects nothing."""

    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def lines_of(text: Column) -> Column:
    """Lines (parts between \\n) that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(A_WORD)))


def let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def covered(positions: Column, width: int) -> Column:
    """How many places the windows of `width` at ascending positions cover."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(width))).alias("n"))
    return F.aggregate(positions, start, add, lambda a: a["n"])


def repeated_words(windows: Column, width: int) -> Column:
    """Words under windows whose 64-bit hash occurs twice or more, from the hashes of a text's windows in order.

    Places ride in the low bits of the hashes, so plain numbers are sorted and repeats are neighbours; the few that look alike are
    told apart by their whole hashes.  n log n in the words of one document, no pairs.
    """
    low = (1 << PLACE_BITS) - 1
    beside = lambda a, i, same: F.coalesce(same(F.get(a, i - 1)), F.lit(False)) | F.coalesce(same(F.get(a, i + 1)), F.lit(False))
    code = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    alike = let(code, lambda a: F.filter(a, lambda x, i: beside(a, i, lambda y: F.shiftright(y, PLACE_BITS) == F.shiftright(x, PLACE_BITS))))
    places = F.transform(alike, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    places = F.when(F.size(windows) <= low, places).otherwise(F.sequence(F.lit(0), F.size(windows) - 1))

    def among(pairs: Column) -> Column:
        found = F.filter(pairs, lambda x, i: beside(pairs, i, lambda y: y["h"] == x["h"]))
        return covered(F.sort_array(F.transform(found, lambda x: x["i"])), width)

    pairs = F.sort_array(F.transform(places, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, among)).otherwise(F.lit(0).cast("long"))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are made once a row, whatever reads them: filters are not pushed through a generator, which would repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def features(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long); columns of these names give way.

    Null and empty texts have zeros.  word_chars are code points in words; n_dup_lines are lines with a word that equal an
    earlier line; n_repeat_words are words in windows of WINDOW words found twice or more in the text, the first included
    (windows are told apart by 64-bit hashes).
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    keep = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = lambda c: c.cast("long")
    got = fixed(docs.select(*keep), _words=words_of(text), _lines=lines_of(text))
    got = fixed(
        got, _hashes=F.transform("_words", lambda w: F.xxhash64(w)), n_words=long(F.size("_words")), word_chars=long(F.length(F.array_join("_words", ""))),
        n_symbols=long(F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0)))),
        n_dup_lines=long(F.size("_lines") - F.size(F.array_distinct("_lines"))), n_lines=long(F.size("_lines")),
    )
    first = F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))
    got = fixed(got, _windows=F.transform(first, lambda h, i: F.xxhash64(h, *(F.get("_hashes", i + k) for k in range(1, WINDOW)))))
    return fixed(got, n_repeat_words=repeated_words(F.col("_windows"), WINDOW)).select(*keep, *names)


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> tuple[Rule, ...]:
    """What prose does not do: words of odd lengths, many symbols, the same lines again, few letters, lists and cut lines only."""
    text, n, lines = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("n_words"), F.col("n_lines")
    lettered = F.size(F.filter(words_of(text), lambda w: F.rlike(w, F.lit(r"\p{L}"))))
    listed = F.size(F.filter(lines_of(text), lambda x: F.rlike(x, F.lit(r"^[ \t]*[•●▪*-]|(\.\.\.|…)[ \t\r]*$"))))
    return (
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("letters", 10 * lettered < 8 * n),
        Rule("lists", 10 * listed > 9 * lines),
    )


def estimated(docs: DataFrame, among: Sequence[Rule], candidates: Column, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share of what is left that it rejects) in the cascade's order.

    `docs` has text; `candidates`, over the columns of `features`, are the rows that the cascade judges.  The sample is written once;
    a rule's cost is the time of a job with that rule alone less that of a job without one, the best of two.  Which rules reject
    a row is a bit set, so one grouped count (at most 2**rules rows) tells what each rule rejects behind any others.
    """
    total = docs.count()
    some = written(features(docs.select("text").sample(min(1.0, sample / max(total, 1)), seed=13)).where(candidates), "quality-sample")
    bit = lambda r, k: F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))

    def took(value: Column) -> float:
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            some.agg(F.sum(value)).collect()
            best = min(best, time.perf_counter() - t)
        return best

    idle = took(F.length("text"))
    cost = [max(took(bit(r, k) + F.length("text")) - idle, 1e-4) for k, r in enumerate(among)]
    mask = F.lit(0)
    for k, r in enumerate(among):
        mask = mask + bit(r, k)
    left = {r["mask"]: r["n"] for r in some.groupBy(mask.alias("mask")).agg(F.count("*").alias("n")).collect()}
    discard(some)
    order, open_ = [], list(range(len(among)))
    while open_:
        rows = max(sum(left.values()), 1)
        share = {k: sum(n for m, n in left.items() if m >> k & 1) / rows for k in open_}
        k = max(open_, key=lambda k: (share[k] / cost[k], -cost[k], -k))
        order.append((among[k], cost[k], share[k]))
        open_.remove(k)
        left = {m: n for m, n in left.items() if not m >> k & 1}
    return order


def cascade(order: Sequence[Rule]) -> Column:
    """The name of the first rule in this order that rejects the row, null for none; later rules are then not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def judged(docs: DataFrame, among: Sequence[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """`docs` with the columns of `features`, base_failed and kept; columns of these names give way.

    kept is false if base_failed, else whether no rule rejects the document.  Texts may be null or empty (they fail the
    base); repeated rows are judged each; an empty table gives an empty one, in the declared order.
    """
    among = rules() if among is None else among
    order = [r for r, *_ in estimated(docs, among, ~base_failed(), sample)]
    got = features(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    return got.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull()))

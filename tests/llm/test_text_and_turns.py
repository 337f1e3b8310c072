"""Phrases, conversation repair and quality rules against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, phrases, quality, repair

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# phrases
def phrase_texts():
    rng = random.Random(4)
    words = ["the", "of", "Of", "état", "x", "new", "york", "city", "a", "und", "ß", "の"]
    out = []
    for i in range(400):
        line = []
        for _ in range(rng.randint(1, 30)):
            line += rng.choice([["new", "york", "city"], ["New", "York"], ["of", "the"], ["rare%d" % rng.randint(0, 60)], [rng.choice(words)]])
            line.append(rng.choice(["", "", "", ",", "\n", ".", "\t"]))
        out.append((" ".join(w for w in line if w), rng.choice(["en", "en", "fr", None])))
    return out + [(None, "en"), ("", None), (" .,\r\n ", "en"), ("long " * 20_000, "de"), ("a b", "one"), *[("same words here", "en")] * 40]


def brute_phrases(rows, least, top, longest=4):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in some.items():
            inside = any(100 * b >= 80 * a for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((" ".join(p), a, f[p[:k]], f[p[k:]], score))
        rows_.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i, p, a, l, r, total[lang], s) for i, (p, a, l, r, s) in enumerate(rows_[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("lookup_rows", [1 << 22, 3])  # a dictionary that workers hold, and one that is joined
def test_phrases(spark, lookup_rows):
    common.ship(spark)
    rows = phrase_texts()
    df = spark.createDataFrame([(t, g, 7, 8) for t, g in rows], "text string, lang string, id int, n int").repartition(5)
    for least, top in ((30, 2000), (5, 7)):
        got = phrases.collocations(df, least, top, lookup_rows=lookup_rows)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)
    assert phrases.collocations(df.limit(0), lookup_rows=lookup_rows).count() == 0


def test_phrases_of_small_portions_and_filters_with_false_alarms(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PORTION", 64)
    rows = phrase_texts()[:150]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df, 10, 50).collect())) == brute_phrases(rows, 10, 50)


def test_scores_pass_64_bits(spark):
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids)
    every = spark.createDataFrame([(bytearray(key(1)), 1, 9 * 10**18), (bytearray(key(2)), 1, 9 * 10**18), (bytearray(key(1, 2)), 2, 8 * 10**18)], "key binary, words int, n long")
    ids = spark.createDataFrame([(1, "en"), (2, "en")], "id long, lang string")
    (row,) = phrases.scored(every, ids).collect()
    assert (row["a"], row["l"], row["r"], row["score"]) == (8 * 10**18, 9 * 10**18, 9 * 10**18, 2000000 * 8 // 18)


# conversations
def conversations():
    rng = random.Random(9)
    out = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            out.append((c, t if rng.random() < 0.9 else t + 2, role, rng.choice(["Yes.", "No!", "why", "", " \n", "Good?\t", None, "same.", f"text {t}."])))
    out += [(500, t, ("user", "assistant")[t % 2], f"turn {t}{'.' * (t % 3 > 0)}") for t in range(700)]
    return out + [(600, None, "user", "null turn."), (600, 1, "assistant", "x."), (None, 3, "user", "no id."), (None, 4, None, None), (700, 5, "assistant", "long. " * 20_000), *[(800, 1, "user", "again.")] * 30]


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            made = (c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            out += [made] * (2 if h == 3 else 1)
    return out


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        if faults[-1] != "blank":
            seen.add((role, text))
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for x, name in (("u", "user"), ("a", "assistant")):
                for i, j in steps[x].items():
                    if i in out:
                        way = (out[i][0] + 2, out[i][1] + "I", [*out[i][2], f"{name}:"])
                        if j not in out or way[:2] < out[j][:2]:
                            out[j] = way
        return out

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        now, before = {}, inserted(best)

        def offer(j, way):
            if j not in now or way[:2] < now[j][:2]:
                now[j] = way

        for i, (cost, audit, told) in before.items():
            offer(i, (cost + 3, audit + "D", told))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if i in steps.get(role[:1], {}):
                    offer(steps[role[:1]][i], (cost + cut, audit + "K", [*told, f"{role}:{text}"]))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if i in steps[x]:
                        offer(steps[x][i], (cost + 2 + cut, audit + "R", [*told, f"{name}:{text}"]))
        best = now
    last = inserted(best)
    cost, audit, told = min((last[i] for i in (0, 3) if i in last), key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def want_repairs(rows):
    left = defaultdict(list)
    for r in brute_damage(rows):
        left[r[0]].append(r)
    return {c: brute_repair(left[c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("bits,fan", [(12, 64), (1, 2)])  # runs of two turns, products of two elements: many levels
def test_repair(spark, monkeypatch, bits, fan):
    common.ship(spark)
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    want = want_repairs(rows)
    assert {k: got[k] for k in got if got[k] != want[k]} == {} and len(got) == len(want)
    assert repair.report(df.limit(0)).count() == 0


def test_repaired_turns_and_edits(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b"), (1, 3, "tool", "t."), (2, 0, "user", " ")]
    answer, turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = [tuple(r) for r in turns.where("conv_id = 1").orderBy("seq").select("role", "text", "edit").collect()]
    assert re.fullmatch("s?(ua)+", "".join(r[0][0] for r in told)) and turns.where("conv_id = 2").count() == 0
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in answer.collect()}[2] == (3, "D")


def test_products_are_associative():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choice("suaoSUAO0123") for _ in range(rng.randint(1, 40)))
        k = rng.randint(0, len(kinds))
        one = repair.product(kinds)
        two = repair.times(repair.product(kinds[:k]), repair.product(kinds[k:])) if 0 < k < len(kinds) else one
        assert one == two


# quality
def quality_texts():
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "naïve", "εpsilon", "zeta", "eta", "theta", "iota"]) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(n))
    out = [prose(rng.randint(1, 200)) for _ in range(80)]
    out += ["one two three four " * 30, "line a b c\n" * 20, "# * $ % & | < > word " * 30, "1 2 3 4 5 6 " * 20, "• item with words\n" * 15, "cut line …\n" * 30, "x" * 400 + " y " * 60]
    return out + [None, "", " \n\t ", "\n\n\n", "    x", prose(30_000), prose(60) + "\r\n" + prose(60), out[0], out[0]]


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    met = Counter(grams)
    under = {i + k for i, g in enumerate(grams) if met[g] > 1 for k in range(3)}
    n, chars, symbols, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)
    failed = n < 50 or 100 * rep > 50 * n
    lettered = sum(bool(re.search(r"[^\W\d_]", x)) for x in w)
    listed = sum(bool(re.search(r"^[ \t]*[•●▪*-]|(\.\.\.|…)[ \t\r]*$", x)) for x in lines)
    bad = chars < 2 * n or chars > 12 * n or 10 * symbols > n or 2 * dup > len(lines) or 10 * lettered < 8 * n or 10 * listed > 9 * len(lines)
    return n, chars, symbols, dup, rep, failed, not failed and not bad


def test_quality(spark):
    texts = quality_texts()
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = quality.judged(df)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = {r["doc_id"]: tuple(r[c] for c in names) for r in got.collect()}
    assert rows == {i: brute_quality(t) for i, t in enumerate(texts)}
    kept = got.where("kept and n_words > 0").count()  # filters above do not repeat the work, nor change it
    assert kept == sum(brute_quality(t)[-1] for t in texts) > 10
    assert quality.judged(df.limit(0)).count() == 0 and not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_many_equal_windows_and_long_texts_are_counted_exactly(spark):
    texts = ["a b c " * 5000, " ".join(str(i) for i in range(20_000)) + " 1 2 3", " ".join("ab"[i % 2] for i in range(999))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_repeat_words"] for r in quality.features(df).orderBy("doc_id").collect()] == [brute_quality(t)[4] for t in texts]


def test_rules_run_by_rejection_per_cost_and_stop_at_the_first(spark):
    df = spark.createDataFrame([(f"text {i} " * 30,) for i in range(400)], "text string")
    slow = F.length(F.regexp_replace(F.repeat("text", 60), "(x|e)(t|x)", "")) < 0
    among = [quality.Rule("costly", slow | F.col("text").contains("7")), quality.Rule("cheap", F.col("text").contains("1")), quality.Rule("idle", F.lit(False)), quality.Rule("unknown", F.lit(None).cast("boolean"))]
    order = quality.estimated(df, among, F.lit(True), sample=400)
    assert [r.name for r, *_ in order][0] == "cheap" and order[0][2] > 0.2 and {r.name for r, *_ in order[2:]} == {"idle", "unknown"}
    told = df.select("text", quality.cascade([r for r, *_ in order]).alias("failed"))
    assert {(r["failed"], "1" in r["text"], "7" in r["text"]) for r in told.collect()} == {("cheap", True, False), ("cheap", True, True), ("costly", False, True), (None, False, False)}
    stops = df.select(quality.cascade([quality.Rule("all", F.lit(True)), quality.Rule("never", F.raise_error(F.lit("ran")).isNull())]).alias("failed"))
    assert stops.where("failed = 'all'").count() == 400

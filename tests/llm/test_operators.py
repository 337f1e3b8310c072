"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from corpusloom.llm import chat, common, debruijn, fst, hnsw, kdtree, minhash, mixing, packing, records, toxicity  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double"


def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (120, 90, 200, 60)]
    out = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = word()
        if i % 7 == 0:
            w = [word() for _ in range(20)] + base[2][30:100] + [word() for _ in range(15)]
        out.append(" ".join(w).replace(" a", "  A", 3))
    out += [None, "", " \n ", "one", "one two", "One Two", "it's 123 <|endoftext|> x　y", "zz " * 9000, out[0], out[0]]
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), i, 0.5) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, none):
    got = {r["doc_id"]: r for r in fst.count_tokens(docs, BYTE).collect()}
    texts = [t or "" for _, t, *_ in documents()]
    for i, (t, x) in enumerate(zip(texts, ids(BYTE, texts), strict=True)):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["n_words"]) == (len(x), len(t.encode()), len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert fst.count_tokens(none, BYTE).count() == 0


def test_state_maps_compose_whatever_the_chunks():
    data = np.frombuffer(b" ab  c\n\nd e" * 40, np.uint8)
    want = fst.segment_counts(data, 1)[-1]
    assert all(fst.segment_counts(data, n)[-1] == want == 160 for n in (2, 3, 7, 64, 5000))


def test_records_round_trip(spark, docs, none):
    manifest = records.write_records(docs, BYTE, 2, partitions=3)
    rows = sorted(records.read_records(spark, manifest).collect())
    start = 0
    for (i, t, *_), x, r in zip(documents(), ids(BYTE, [t or "" for _, t, *_ in documents()]), rows, strict=True):
        x = np.array([*x, 2], "<u4")
        assert tuple(r) == (i, start, len(x), zlib.crc32(x))
        start += len(x)
    one = manifest.first()
    entry = records.read_index(one["folder"], one["path"])[2]
    key, found = records.read_record(one["folder"], one["path"], int(entry["offset"]))
    assert key == entry["key"] and len(found) == entry["tokens"]
    with pytest.raises(ValueError):
        records.unframe(records.frame(b"abc")[:-1] + b"x")
    assert records.read_records(spark, records.write_records(none, BYTE, 2)).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORD, 512, 1).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for (i, *_), x in zip(documents(), ids(WORD, [t or "" for _, t, *_ in documents()]), strict=True):
        x = np.array([*x, 1], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(x), 512))
        assert all(r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]]) for r in parts)
        total += len(x)
    for spans in by_bin.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    more_than_half = sum(r["length"] > 256 for r in rows)  # no two of these share a sequence
    assert len(by_bin) <= 1.15 * max(-(-total // 512), more_than_half)  # many pieces lie just above a third or a half of 512
    assert packing.pack_documents(none, WORD).count() == 0


def test_local_search_empties_bins():
    bins = packing.Bins(np.array([6, 6, 4, 4, 5, 5]), 10)
    bins.of, bins.fill = np.array([0, 1, 2, 3, 2, 3]), np.array([6, 6, 9, 9])
    bins.improve()
    assert bins.steps > 0 and sorted(f for f in bins.fill if f) == [10, 10, 10]


def test_local_search_keeps_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(5, 60, rng.integers(1, 60))
        bins = packing.Bins(sizes, 100)
        bins.best_fit()
        before = int((bins.fill > 0).sum())
        squares = int((bins.fill**2).sum())
        bins.improve()
        assert (np.bincount(bins.of, weights=sizes, minlength=len(bins.fill)) == bins.fill).all() and bins.fill.max() <= 100
        assert int((bins.fill > 0).sum()) <= before and int((bins.fill**2).sum()) >= squares
    assert packing.pack_sizes(np.zeros(0, np.int64), 100)[0].tolist() == []


def test_packing_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, "c d")], "doc_id long, text string").withColumn("offset", F.lit("x"))
    rows = packing.pack_documents(df, WORD, 8, 1).collect()
    assert len(rows) == 5 and sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 1, 1]
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ids(WORD, ["a b", "a b", "c", "c", "c d"]))


def test_substring_dedup(docs, none):
    rows = documents()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: r for r in debruijn.remove_repeats(docs, 50, keep_text=True, carried=("lang", "source")).collect()}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), len(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and got[i]["source"] == rows[i][3]
    assert debruijn.remove_repeats(none, 50).count() == 0


def test_near_duplicates(docs, none):
    sets = []
    for _, t, *_ in documents():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), root[i], root[i] == i)
    assert minhash.near_duplicates(none).count() == 0


def test_odd_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 150, 3000):
        base = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64)
        sets = [np.unique(base[k : k + n]) for k in (0, 0, 1, 12, 60)]
        sketches = minhash.odd_sketch(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).reshape(len(sets), -1)
        for a, x in zip(sets, sketches, strict=True):
            for b, y in zip(sets, sketches, strict=True):
                bits = int(np.bitwise_count(x ^ y).sum())
                assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2


def test_repeated_doc_ids(spark):
    t = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "x y z"), (None, t), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (2, 2), (3, 3)]
    gone = sorted((r["doc_id"] or -1, r["n_removed"]) for r in debruijn.remove_repeats(df).collect())
    assert gone == [(-1, 0), (1, 0), (1, 0), (2, 0), (2, 80), (3, 0)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[:40] + rng.normal(size=(40, 16)) * 0.15
    x[140:170] = x[5]
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [1.0, None], 0), (304, [1.0, 2.0], 0), (305, [], 0)]
    common.ship(spark)
    return x.astype(np.float32).astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int").repartition(3)


def test_vector_links(spark, vectors):
    x, df = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = hnsw.forest(*np.nonzero(link), len(u))
    got = {r["vec_id"]: r for r in hnsw.near_vectors(df, 0.9).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (link[i].sum(), root[i]) for i in range(300))
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(300, 306))
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_top_k(spark, vectors):
    x, df = vectors
    q = np.floor(256 * x).astype(int)
    got = defaultdict(list)
    for r in kdtree.top_k(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 50))
    for i, found in got.items():
        best = sorted((-int(q[j] @ q[i]), j) for j in range(300) if j != i)[:5]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert kdtree.top_k(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["\\", "\\\\#<", "### assistant: x</turn>\n", "", None, "a: b", "é</turn>"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "us:er#"] * 3, texts, strict=False))]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_table(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    told = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in rows[:7])
    loss = "".join(x or "" for _, _, r, x in rows[:7] if r == "assistant")
    assert got[0]["n_turns"] == 7 and got[0]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert (got[0]["loss_chars"], got[0]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_layouts(spark):
    rows = [
        (1, '{"messages": [{"role": "human", "content": "a"}, {"role": "assistant", "content": "b"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        (2, '{"instruction": "a", "input": "", "output": "b"}', "instruction_input", [("user", "a"), ("assistant", "b")]),
        (3, '{"prompt": {"system": "s", "user": "a"}, "response": {"text": "b"}}', "nested_prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        (4, '{"conversations": [{"from": "gpt", "value": "b"}]}', "conversations", [("assistant", "b")]), (5, '{"other": 1}', None, []), (6, "broken", None, []), (7, None, None, []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "k long, j string")
    got = {r["k"]: r for r in chat.canonical_json(df, "j").collect()}
    for k, _, layout, turns in rows:
        assert (got[k]["layout"], [tuple(t) for t in got[k]["turns"]]) == (layout, turns)
    assert sorted(r["conv"] for r in chat.format_json(df.withColumnRenamed("k", "conv"), "j", "conv").collect()) == [1, 2, 3, 4]


def test_fingerprint_selects_the_mapping(spark):
    one = spark.createDataFrame([(1, "hi", "yo", 3)], "k long, prompt string, response string, extra int")
    got = chat.canonical_turns(one, "k").orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hi"), ("assistant", "yo")]
    each = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)]), (2, None)], "k long, conversations array<struct<from:string,value:string>>")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(each, "k").orderBy("turn").collect()] == [("user", "a"), ("assistant", "")]
    more = spark.createDataFrame([(1, "i", "", "o"), (2, "i", "m", "o")], "k long, instruction string, input string, output string")
    assert chat.canonical_turns(more, "k").groupBy("k").count().orderBy("k").collect() == [(1, 2), (2, 3)]
    other = (chat.Layout("mine", ("role", "text", "turn"), row=("turn", "text", "role")),)  # another mapping of one fingerprint gives another result
    rows = spark.createDataFrame([(1, 0, "user", "x"), (None, 1, "user", "y")], "conv_id long, turn int, role string, text string")
    assert {(r["role"], r["text"]) for r in chat.canonical_turns(rows, layouts=other).collect()} == {("x", "user"), ("y", "user")}
    assert chat.read_back(chat.format_table(rows)).count() == 2 and chat.read_back(chat.format_table(rows.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_table(one.drop("prompt"), "k", layouts=())


def poisson_inverse(rate, u):
    """The smallest k whose cumulative probability exceeds u."""
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while u >= total:
        k += 1
        term *= rate / k
        total += term
    return k


def test_mixing_inverts_the_poisson_distribution(spark):
    rows = [(i, ["a", "b", None, "zero"][i % 4], [100, 700, 40, 0][i % 4], 9.0, "c") for i in range(400)] + [(None, "a", 100, 1.0, "c"), (7, "a", None, 1.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, _rate double, mix_key string")
    size = defaultdict(float)
    for _, s, n, *_ in rows:
        size[s] += n or 0
    weight = {s: n**0.5 for s, n in size.items() if n}
    rate = {s: (w / sum(weight.values()) * sum(size.values()) / size[s]) for s, w in weight.items()}
    want = sum((poisson_inverse(rate[s], int(hashlib.md5(f"3|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52) for i, s, *_ in rows if s in rate), 0)
    got = mixing.mix(df, seed=3).collect()
    assert len(got) == want and all(r["_rate"] in (1.0, 9.0) for r in got)


def test_mixing(docs, none):
    got = mixing.mix(docs, seed=1, budget=3.0).groupBy("source").agg(F.sum("n_chars").alias("n")).collect()
    assert mixing.mix(docs, seed=1).select("doc_id", "copy").exceptAll(mixing.mix(docs, seed=1).select("doc_id", "copy")).count() == 0
    assert {r["source"] for r in got} == {"a", "b", None} and mixing.mix(none).count() == 0
    n = mixing.mix(docs, seed=2, weights={"a": 1.0}).select("source").distinct().collect()
    assert [r["source"] for r in n] == ["a"]


def labelled(n=600):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(5))
    rows = []
    for i in range(n):
        w = [word() for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["vilest,", "Scoundrel"])
        rows.append((i, " ".join(w), "en", int(i % 4 == 0)))
    return rows


def auc(model, rows):
    made = [(toxicity.word_buckets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0], y) for _, t, _, y in rows]
    own = np.concatenate([[0], np.cumsum([len(w) for w, _ in made])])
    z, y = model.outputs(np.concatenate([w for w, _ in made]), own), np.array([y for _, y in made])
    return (z[y == 1][:, None] > z[y == 0][None]).mean()


def test_training_and_nothing_else_tells_classes_apart():
    rows = labelled()
    train = [(toxicity.word_buckets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0], y) for _, t, _, y in rows[:400]]
    assert auc(toxicity.train(train, epochs=()), rows[400:]) < 0.7 and auc(toxicity.train(train), rows[400:]) > 0.97


def test_toxicity_learns_held_out(spark):
    common.ship(spark)
    told = labelled(1500)
    rows = [(i, t, lang, "x", 0.5) for i, t, lang, _ in told] + [(6000, None, None, "x", 0.5), (6001, "", "en", "x", 0.5), (None, "a", "en", "x", 0.5)]
    labels = spark.createDataFrame([(i, y) for i, _, _, y in told], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, _cut double")
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    assert len(got) == 1503 and got[6000]["predicted"] == got[6001]["predicted"] == 0 and got[None]["held_out"] is None
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.93 * len(held)
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(df.drop("lang", "_cut"), labels.limit(0)).collect()} <= {0, 1}


def test_logistic_calibration_fits_slope_and_shift():
    z = np.arange(-300, 300) / 50
    p = 1 / (1 + np.exp(-(2.0 * z - 1.0)))
    slope, shift = toxicity.logistic(z, 1000 * p, 1000 * (1 - p))
    assert abs(slope - 2) < 0.02 and abs(shift + 1) < 0.02
    assert toxicity.logistic(z, p, 0 * p) == (1.0, 0.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


def vector_links(spark, x):
    """(n_links, component_id) of each row by near_vectors, and by brute force."""
    common.ship(spark)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = hnsw.unit(x)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = hnsw.forest(*np.nonzero(link), len(u))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_vectors(df, 0.9).collect()}
    return [got[i] for i in range(len(x))], list(zip(link.sum(1).tolist(), root.tolist(), strict=True))


def test_vector_links_of_nodes_that_no_walk_reaches(spark):
    rng = np.random.default_rng(5)
    got, want = vector_links(spark, rng.normal(size=2) + rng.normal(size=(3000, 2)) * 1e-5)
    assert got == want


def test_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 1e-3
    pairs = rng.normal(size=(1500, 64)) * 0.45 + rng.normal(size=64)
    noise = rng.normal(size=(1500, 64))
    noise *= 0.44 * np.linalg.norm(pairs, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    got, want = vector_links(spark, np.concatenate([hot, pairs, pairs + noise]))
    assert got == want


def test_comparisons_by_bounds_are_exact():
    """Components of any weight, groups in a block, few components; a beam that misses links is checked."""
    rng = np.random.default_rng(9)
    for d in (2, 20, 64):
        x = rng.normal(size=(2500, d)) * np.where(np.arange(d) % 3, 1e-3, 1)
        u = hnsw.unit(np.concatenate([x, x[:300] + rng.normal(size=(300, d)) * 0.2, rng.normal(size=(900, d)) * 1e-3 + x[0]]))
        graph, want = hnsw.Graph(u, np.arange(len(u))), u @ u.T >= 0.9
        own = np.arange(len(u))
        for parts in (graph.compared(u, own, 0.9), hnsw.linked(graph, u, own, 0.9, 1)):
            got = np.zeros_like(want, dtype=int)
            for r, node in parts:
                np.add.at(got, (r, node), 1)
            assert (got == want).all()
    heads = graph.heads(graph.x)
    assert len(heads) == 24 and set(heads) >= set(range(0, 64, 3)) and hnsw.Graph.heads(graph, graph.x[:, :20]) is None
    far = u[:2500][rng.permutation(2500)[:400]]
    assert (hnsw.bounded(far, heads) @ hnsw.bounded(far, heads).T >= far @ far.T - 1e-9).all()


def test_walked_graphs_miss_no_links():
    rng = np.random.default_rng(6)
    flat = rng.normal(size=2) + rng.normal(size=(3000, 2)) * 1e-5
    hot = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 1e-3
    pairs = rng.normal(size=(1500, 64)) * 0.45 + rng.normal(size=64)
    noise = rng.normal(size=(1500, 64))
    noise *= 0.44 * np.linalg.norm(pairs, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    began = time.process_time()
    for x in (flat, np.concatenate([hot, pairs, pairs + noise])):
        u, part = hnsw.unit(x), np.arange(0, len(x), 6)
        graph = hnsw.Graph(u[part], part)
        own = np.full(len(u), -1)
        own[part] = np.arange(len(part))
        beam, *_ = hnsw.audited(graph, u, np.arange(len(u)), own, 0.9, hnsw.shard_beam(graph, part, 0.9))
        found = list(hnsw.linked(graph, u, own, 0.9, beam))
        n, want = sum(np.bincount(r, minlength=len(u)) for r, _ in found), (u @ u[part].T >= 0.9).sum(1)
        assert (n <= want).all() and n.sum() >= 0.995 * want.sum()
    assert hnsw.shard_beam(graph, part, 0.9) == hnsw.BEAM and time.process_time() - began < 60


def planted_vectors(n, seed):
    """Rows of 64 components, of which the last tenth lie at cosines from 0.9 to 0.92 from the first."""
    rng = np.random.default_rng(seed)
    x = hnsw.unit(rng.normal(size=(n, 64)))
    k = n // 10
    away = rng.normal(size=(k, 64))
    away -= (away * x[:k]).sum(1, keepdims=True) * x[:k]
    cos = rng.uniform(0.9001, 0.92, size=(k, 1))
    x[-k:] = cos * x[:k] + np.sqrt(1 - cos * cos) * hnsw.unit(away)
    return x, k


@pytest.mark.parametrize("n", [600, 6000, 30_000])
def test_links_just_above_the_least_cosine_are_found_at_every_size(spark, n):
    common.ship(spark)
    x, k = planted_vectors(n, n)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got, audits = hnsw.searched(df, 0.9, shard_rows=max(200, n // 8))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    met = sum(got[n - k + i] == (1, i) and got[i] == (1, i) for i in range(k))
    assert len(got) == n and met >= 0.99 * k and sum(a for a, _ in got.values()) <= 2 * k
    told = audits.agg(F.sum("found").alias("found"), F.sum("links").alias("links"), F.sum("asked").alias("asked")).first()
    assert told["links"] is not None and told["found"] >= 0.98 * told["links"]


def test_bounds_of_caps_spare_shards_and_lose_nothing(spark):
    common.ship(spark)
    rng = np.random.default_rng(8)
    # clusters far from each other, one with a third of the rows
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(n, 32)) * rng.uniform(0.02, 0.3) for n in (900, *[225] * 8)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, audits = hnsw.searched(df, 0.9, shard_rows=60)
    u = hnsw.unit(x)
    link = u @ u.T >= 0.9
    want = hnsw.forest(*np.nonzero(link), len(u))
    assert [tuple(r)[1:3] for r in got.orderBy("vec_id").collect()] == list(zip((link.sum(1) - 1).tolist(), want.tolist(), strict=True))
    told = audits.agg(F.count("*").alias("shards"), F.sum("asked").alias("asked")).first()
    assert told["shards"] >= 40 and told["asked"] < 0.5 * told["shards"] * len(x)


def test_vector_links_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>").withColumn("dim", F.lit(1))
    got = sorted(tuple(r) for r in hnsw.near_vectors(df).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_top_k_of_large_components_ties_and_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [1.0, 2.0]), (50, [2.0, 1.0]), (51, [1e12, 3.0])], "vec_id long, embedding array<double>").withColumn("kth", F.lit(1))
    got = [tuple(r) for r in kdtree.top_k(df).orderBy("query_id", "rank").collect()]
    assert [x[2] for x in got if x[0] == 0] == [1, 2, 50, 50, 51] and all(x[3] == (1 << 63) - 1 for x in got if x[0] == 0)
    assert [x[2:] for x in got if x[0] == 50] == [(0, (1 << 63) - 1), (51, 256 * 256 * (10**12 + 6)), (1, 3 * 256 * 256), (2, 3 * 256 * 256)]


def test_spans_are_verified_on_text(spark):
    shared = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, "a b " + shared), (2, shared.replace(" ", "  ") + " c"), (3, "x " + shared)], "doc_id long, text string")
    common.ship(spark)
    rows = debruijn.rows_of(df)
    spans = debruijn.repeated_spans(rows)
    out = lambda s: {r["doc_id"]: r["n_removed"] for r in debruijn.without(rows, s, 50, False).collect()}
    assert out(spans) == {1: 0, 2: 80, 3: 80} and spans.select(F.sum(F.size("spans"))).first()[0] == 2
    forged = spans.withColumn("digests", F.transform("digests", lambda d: F.lit(b"0" * 16)))
    assert out(forged) == {1: 0, 2: 0, 3: 0}


def test_mixing_honours_large_rates(spark):
    rows = [(i, "large", 1_000_000) for i in range(20)] + [(100 + i, "small", 1000) for i in range(10)] + [(200, "tiny", 100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    n = {r["source"]: r["n"] for r in mixing.mix(df, weights={"large": 18.0, "small": 1.0, "tiny": 1.0}).groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    # a twentieth of 20 million characters each: rates of 100 and of 10,001
    assert abs(n["small"] / 1_000_505 - 1) < 0.2 and abs(n["tiny"] / 1_000_505 - 1) < 0.06


def test_mixing_rows_without_a_key(spark):
    df = spark.range(0, 4000, 1, 2).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'a', 'b') as source", "if(id % 2 = 0, 100L, 400L) as n_chars")
    got = mixing.mix(df, seed=5)
    sizes = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    assert abs(sizes["b"] / sizes["a"] / 2 - 1) < 0.15 and got.select("mix_key").distinct().count() == got.count()


def test_batches_for_workers_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('word ', if(id = 7, 2000000, 2000)) as text")
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches)
    model = toxicity.Model.random()
    made = (
        lambda: debruijn.paths(docs.selectExpr("doc_id", "0L as rid", "text"), 50, 12), lambda: minhash.signatures(docs, 3, 8), lambda: minhash.full_sets(docs.withColumnRenamed("doc_id", "id"), 3),
        lambda: packing.encode_pieces(docs, WORD, 4096, 1), lambda: toxicity.with_output(docs.withColumnRenamed("text", "_text"), model),
    )
    for make in made:
        spark.conf.unset(key)
        make()
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 2000 and all(r["bytes"] <= common.BATCH_BYTES + 20_000 for r in got if r["bytes"] < 10_000_000) and len(got) > 4
    spark.conf.set(key, "1m")
    made[0]()
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
    assert toxicity.with_output(docs.withColumnRenamed("text", "_text"), model).columns == ["doc_id", "_z"]

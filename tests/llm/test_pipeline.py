"""The pipeline's stages, each against what its small input should leave."""

import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: every fourth of 400 holds a toxic word; copies, a shared passage, nulls."""
    rng, at = random.Random(4), tmp_path_factory.mktemp("sf")
    passage = prose(rng, 70)
    rows = []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["vilest", "scoundrel"])
        rows.append((i, " ".join(words), ["en", "de"][i % 2], ["a", "b"][i % 3 == 0]))
    rows += [(1001, rows[1][1], "en", "a"), (1002, rows[2][1] + " more", "en", "a"), (1003, prose(rng, 30) + " " + passage, "en", "b"), (1004, passage + " " + prose(rng, 300), "de", "b"), (1005, None, None, None), (1006, "", "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, folder).collect()}
    toxic = {i for i in range(0, 400, 4)}
    assert len(left & toxic) <= 20 and len({r["doc_id"] for r in docs.collect()} - toxic - left) <= 20


def test_near_duplicates_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    assert {r["doc_id"] for r in docs.collect()} - left == {1001, 1002}
    twice = docs.where("doc_id in (1, 2, 1001, 1005)").union(spark.createDataFrame([(1, "another text under one id of more than five words", "en", "a", 1), (1, None, "en", "a", 1)], SCHEMA))
    texts = sorted(r["text"] or "" for r in pipeline.drop_near_duplicates(spark, twice, folder).collect())
    assert len(texts) == 5 and len(set(texts)) == 4  # of the copy in 1 and 1001 one stays; null texts stay


def test_repeated_spans_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, pipeline.drop_repeats(spark, docs, folder)))
    changed = {i for i in before if before[i]["text"] != after[i]["text"] and (before[i]["text"] or after[i]["text"])}
    assert changed == {1001, 1002, 1004} and len(re.findall(r"\S+", after[1004]["text"])) == 300 and after[1004]["n_chars"] == len(after[1004]["text"])
    assert after[1002]["text"] == "more"


def test_mixture_and_packing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    path = f"{folder}/mixed"
    mixed.write.parquet(path)
    mixed = spark.read.parquet(path)
    rows = pipeline.pack(spark, mixed, folder).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(encoder.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in rows) == want and len({r["row"] for r in rows}) == mixed.count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_run(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "mix_sources", "best_fit_packing"]
    got = pipeline.run(spark, folder)
    assert got.count() > 200 and {"doc_id", "row", "sequence_id", "offset"} <= set(got.columns)

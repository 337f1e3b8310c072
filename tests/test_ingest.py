"""Ingest by committed runs: one call, idempotent, refused while unfinished, safe against races; digests that locate damage."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom import cli, ingest
from corpusloom.functions import features, normalize
from corpusloom.functions import text as tx
from corpusloom.operators import alignment, bitmaps, digests, search, stream
from corpusloom.plans import scope, skipping
from corpusloom.plans.ast import RequestError
from corpusloom.plans.binding import base
from corpusloom.plans.engine import Engine
from corpusloom.queries import conversation_tokens
from corpusloom.store import Store, Unfinished

CORPUS = "1|1|alpha beta gamma beta\n1|2|delta alpha\n# a comment\n2|1|beta\n"
NOTES = "\n".join([
    "1:1:1\talpha\tt\tN\tone\tr1\tPOS=N\t1", "1:1:1\talpha\tt\tN\ttwo\tr1\tPOS=N\t2", "1:1:2\tgamma\tt\tV\tg\tr2\t\t", "1:1:1\tbeta\tt\tV\tb\tr2\t\t", "1:2:9\tx\tt\tN\tx\tx\t\t",
    "1:2:1\tnone\tt\tN\tx\tx\t\t", "1:2:x\tx\tt\tN\tx\tx\t\t", "broken\tline", "# comment", "1:1:3:1\tgamma\tt\tN\tg\tr2\t\t",
]) + "\n"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "c.txt").write_text(CORPUS)
    (tmp_path / "n.tsv").write_text(NOTES)
    return str(tmp_path / "c.txt"), str(tmp_path / "n.tsv")


def test_one_call_aligns_a_file_and_a_second_adds_nothing(spark, tmp_path, files):
    store = Store(spark, f"file://{tmp_path}/store")
    text = ingest.ingest_text(store, files[0])
    assert text["about"]["counts"] == {"lines": 4, "units": 3, "tokens": 7} and not text["idempotent"]
    first = ingest.ingest_annotations(store, files[1], "synthetic", text["run"])
    assert first["about"]["records"] == {"parsed": 8, "malformed": 1, "unknown": 1} and first["about"]["analyses"] == 8
    rows = [(r["rule"], r["status"], r["confidence"], tuple(r["conflict_dimensions"])) for r in store.table("alignments").orderBy("segment_id").collect()]
    assert rows == [
        ("exact_token", "conflict", 1.0, ("lemma",)), ("exact_token", "conflict", 1.0, ("lemma",)), ("bounded_candidate", "conflict", 0.6, ("pos",)), ("bounded_candidate", "ambiguous", 0.0, ()),
        ("missing_locator", "unaligned", 0.0, ()), ("surface_mismatch", "unaligned", 0.0, ()), ("invalid_locator", "unaligned", 0.0, ()), ("segment_exact", "conflict", 1.0, ("pos",)),
    ]
    before = store.manifest()
    again = [ingest.ingest_text(store, files[0]), ingest.ingest_annotations(store, files[1], "synthetic", text["run"])]
    assert [a["run"] for a in again] == [text["run"], first["run"]] and all(a["idempotent"] for a in again) and store.manifest() == before
    by_address = ingest.ingest_annotations(store, files[1], "synthetic", text["run"], ingest.BY_ADDRESS)
    assert by_address["run"] != first["run"] and store.table("alignments").groupBy("alignment_id").count().where("count > 1").count() == 0
    evidence = ingest.evidence(store)
    assert evidence.count() == store.table("alignments").count() and evidence.where("token_id is null").count() == store.table("alignments").where("token_id is null").count()


def test_unfinished_runs_are_refused_and_unseen(spark, tmp_path, files, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    text = ingest.ingest_text(store, files[0])
    with monkeypatch.context() as m:
        m.setattr(ingest.alignment, "check_partition", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            ingest.ingest_annotations(store, files[1], "synthetic", text["run"])
    assert store.table("alignments") is None
    with pytest.raises(Unfinished) as refused:
        ingest.ingest_annotations(store, files[1], "synthetic", text["run"])
    store.give_up(str(refused.value).split("key ")[1].split()[0])
    assert ingest.ingest_annotations(store, files[1], "synthetic", text["run"])["about"]["analyses"] == 8 and store.table("alignments").count() == 8
    with pytest.raises(ValueError, match="no text release"):
        ingest.ingest_annotations(store, files[1], "synthetic", 99)
    (tmp_path / "bad.txt").write_text("1|1|x\n1|1|y\n")
    with pytest.raises(ValueError, match="faults"):
        ingest.ingest_text(store, str(tmp_path / "bad.txt"))


def test_racing_writers_lose_no_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    tables = {k: store.write(store.claim(k), "t", spark.range(3).withColumn("k", F.lit(k))) for k in "abcdefgh"}
    runs, gate = {}, threading.Barrier(8)

    def commit(k):
        gate.wait()
        runs[k] = store.commit(k, ord(k), {"t": tables[k]}, {"kind": "x"})

    threads = [threading.Thread(target=commit, args=(k,)) for k in "abcdefgh"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = store.manifest()
    assert now["version"] == 8 and sorted(now["runs"]) == list("abcdefgh") and store.table("t").count() == 24
    won = []
    gate2 = threading.Barrier(6)

    def claim():
        gate2.wait()
        try:
            won.append(store.claim("one"))
        except Unfinished:
            pass

    threads = [threading.Thread(target=claim) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store.commit("a", 99, {}, {})["run"] == ord("a")


def test_digests_add_up_and_locate_damage(spark):
    rows = [(u, k, "x" * k, None if k % 2 else b"\xff") for u in range(20) for k in range(5)]
    df = spark.createDataFrame(rows, "unit int, k int, text string, raw binary")
    assert digests.table_digest(df.repartition(7)) == digests.table_digest(df.orderBy(F.desc("k")).coalesce(1))
    assert digests.table_digest(df) != digests.table_digest(df.unionByName(df.limit(1))) and digests.table_digest(df.limit(0))
    bad = df.withColumn("text", F.when((F.col("unit") == 7) & (F.col("k") == 3), "xxy").otherwise(F.col("text"))).where("unit <> 9")
    assert sorted(map(tuple, digests.differences(df, bad, "unit").collect())) == [(7, 5, 5), (9, 5, 0)]


def test_stream_windows_cross_partitions_of_any_size(spark):
    words = [(c, u, t, f"w{(c * 7 + u * 3 + t) % 5}") for c in range(6) for u in range(3) for t in range(1, 5)]
    df = spark.createDataFrame(words, "c int, u int, token_no int, surface string").withColumn("end", F.lit(1))
    all_ = [w[3] for w in words]
    for parts in (1, 2, 13, 60):  # ranges of one row too
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {(r["gram"], r["n"]) for r in search.repeated_ngrams(df, 4, ["c", "u"], cross_unit=True).collect()}
            hits = search.phrase(df, "w1 w2 w3", ["c", "u"], cross_unit=True).count()
            sums = [r["before"] for r in stream.running(df, ["c", "u", "token_no"], {"before": F.length("surface")}).orderBy("c", "u", "token_no").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        grams = [" ".join(all_[i : i + 4]) for i in range(len(all_) - 3)]
        assert got == {(g, grams.count(g)) for g in grams if grams.count(g) > 1}
        assert hits == sum(all_[i : i + 3] == ["w1", "w2", "w3"] for i in range(len(all_))) and sums == [2 * i for i in range(len(all_))]


def test_no_shuffle_for_phrases_inside_units(spark):
    units = spark.createDataFrame([(1, " of the  of\tthe of the"), (2, "of"), (3, None), (4, "THE of the")], "id int, text string")
    found = search.phrase_in_units(units, "of the", ["id"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 7), (1, 3, 9, 15), (1, 5, 16, 22), (4, 2, 4, 10)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_conversations_are_counted_once(spark):
    assert conversation_tokens(spark, "/root/testdata/sf0.001").count() == 6463


def run_cli(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    out = capsys.readouterr()
    return code, [json.loads(x) for x in (out.out or out.err).splitlines()]


def test_command_line_ingests_and_inspects(spark, tmp_path, files, capsys):
    store = f"file://{tmp_path}/store"
    code, (text,) = run_cli(capsys, "ingest-text", store, files[0])
    assert code == 0 and text["run"] == 1
    assert run_cli(capsys, "ingest-annotations", store, files[1], "synthetic", 1)[1][0]["run"] == 2
    assert [r["kind"] for r in run_cli(capsys, "runs", store)[1][0]] == ["text", "annotations"]
    assert {r["locator"] for r in run_cli(capsys, "alignment", store, "--status", "unaligned")[1]} == {"1:2:9", "1:2:1", "1:2:x"}
    assert len(run_cli(capsys, "alignment", store, "--conflict", "lemma")[1]) == 2 and len(run_cli(capsys, "alignment", store, "--locator", "1:1:1", "--limit", 2)[1]) == 2
    ask = '{"where": {"dimension": "root", "operator": "eq", "value": "r1"}}'
    code, (got,) = run_cli(capsys, "research", store, ask, "--store")
    assert code == 0 and "r1" in json.dumps(got)
    assert run_cli(capsys, "research", store, '{"where": {"dimension": "source_release", "operator": "eq", "value": 9}}', "--store")[0] == 2
    code, (area,) = run_cli(capsys, "scope", '{"unit_ranges": [[1, 2, 2], [1, 1, 1]]}', "--corpus", files[0])
    assert code == 0 and area["units"] == 2 and area["scope"]["unit_ranges"] == [[1, 1, 2]]
    assert run_cli(capsys, "scope", '{"nothing": 1}')[0] == 2 and run_cli(capsys, "locks")[0] == 0
    assert {r["character"]: r["n"] for r in run_cli(capsys, "unicode", files[0])[1][0]}["a"] == 10
    assert run_cli(capsys, "release-manifest", store)[1][0]["source_releases"][0]["source_release_id"] == 2
    assert [r["token_no"] for r in run_cli(capsys, "search", "phrase", files[0], "beta delta", "--cross-unit")[1]] == [4]


def test_logs_tell_every_step_as_columns(spark):
    tokens = spark.createDataFrame([(1, "أَۖx", [7, 8, 9, 10]), (2, "", []), (3, None, None)], "id int, surface string, ids array<long>")
    rows = {r["id"]: r for r in normalize.explained(tokens, "base_arabic_letters_v1", "id", ids="ids").collect()}
    assert rows[3]["value"] is None and rows[2]["log"] == [] and (rows[1]["value"], rows[1]["mapping"]) == ("اx", [7, 10])
    told = [(e["operation"], e["input_index"], e["source"], e["action"], e["output_index"]) for e in rows[1]["log"]]
    assert told == [(0, 0, 7, "keep", 0), (0, 1, 8, "drop", None), (0, 2, 9, "drop", None), (0, 3, 10, "keep", 1), (1, 0, 7, "keep", 0), (1, 1, 10, "keep", 1), (2, 0, 7, "replace", 0), (2, 1, 10, "keep", 1)]
    assert rows[1]["log"][1]["reason"] == "general_category_prefix:M" and rows[1]["log"][6]["reason"] == "configured_codepoint_mapping"


def test_sums_of_logs_are_those_of_their_entries(spark, monkeypatch):
    """A log is made once a surface, whatever worker memory holds; empty and null surfaces have no entry."""
    words = ["أَۖx", "plain", "", None, "آ", "\u0301", "plain"]
    tokens = spark.createDataFrame([(None if k == 2 else k, w) for k in range(4) for w in words * 3], "id int, surface string").coalesce(1)
    log = normalize.explained(tokens, "base_arabic_letters_v1", "id").select("id", F.explode("log").alias("e"))
    want = log.groupBy("id", "e.operation", "e.action").agg(F.count("*").alias("n"), F.sum("e.input_index").alias("places"), F.sum("e.source").alias("sources"), F.sum("e.output_index").alias("outputs"))
    for kept in (1, 1 << 16):
        monkeypatch.setattr(normalize, "KEPT", kept)
        assert sorted(map(str, normalize.explained_sums(tokens, "base_arabic_letters_v1", "id").collect())) == sorted(map(str, want.collect())) != []
    assert normalize.explained_sums(tokens.where("surface is null"), "base_arabic_letters_v1", "id").count() == 0
    made = []
    monkeypatch.setattr(normalize, "explain_value", lambda *a, f=normalize.explain_value: made.append(a) or f(*a))
    run, schema = [], []
    monkeypatch.setattr(type(tokens), "mapInArrow", lambda df, f, s: run.append(f) or schema.append(s) or tokens.selectExpr("id", "1 as operation", "'x' as action", "1L as n", "1L as places", "1L as sources", "1L as outputs"))
    normalize.explained_sums(tokens, "base_arabic_letters_v1", "id")
    batch = __import__("pyarrow").RecordBatch.from_pylist([{"id": 1, "_surface": w} for w in words * 50])
    (out,) = run[0](iter([batch]))
    assert len(made) == 5 and out.num_rows < 10


def test_scopes_that_say_the_same_are_equal(spark):
    one = {"source_order_ranges": [[5, 9], [1, 3], [4, 4]], "include_collections": [2, 1, 2]}
    assert scope.scope_hash(one) == scope.scope_hash({"include_collections": [1, 2], "source_order_ranges": [[1, 9]]}) != scope.scope_hash({"include_collections": [1, 2]})
    units = spark.createDataFrame([(10 + i, 1 + i // 4, 1 + i % 4, i + 1, "numbered" if i % 2 else "other") for i in range(12)], "unit_id int, collection_no int, unit_no int, source_order int, unit_type string")
    ids = lambda **config: [r["unit_id"] for r in scope.scoped(units, config).orderBy("unit_id").collect()]
    assert ids() == list(range(10, 22)) and ids(unit_types=["numbered"], exclude_collections=[2]) == [11, 13, 19, 21]
    assert ids(exact_units=[[3, 4]], unit_ranges=[[1, 2, 3]], source_order_ranges=[[6, 6]]) == [11, 12, 15, 21]
    ordered = scope.scoped(units, {"ordered_unit_ids": [20, 11, 13, 11]}).orderBy("scope_order")
    assert [r["unit_id"] for r in ordered.collect()] == [20, 11, 13] and ids(include_collections=[]) == []
    with pytest.raises(RequestError):
        scope.canonical_scope({"unit_ranges": [[1, 3, 2]]})


def test_selective_requests_open_few_files(spark, tmp_path):
    from corpusloom import queries as q

    path, where = f"file://{tmp_path}/ev", f"file://{tmp_path}/index"
    q.evidence(spark, "/root/testdata/sf0.001").repartitionByRange(8, "root", "lemma", "alignment_id").write.partitionBy("release_id").parquet(path)
    whole = spark.read.parquet(path)
    skipping.write_index(whole, where)
    index = spark.read.parquet(where)
    lemma = base(whole).where("lemma is not null").groupBy("lemma").count().orderBy("count", "lemma").first()["lemma"]
    ask = q._query({"and": [q.p("feature", f"LEM:{lemma}"), {"not": [q.p("root", "zzz")]}]})
    some = skipping.evidence_for(spark, path, index, ask)
    assert len(whole.inputFiles()) >= 8 and 1 <= len(some.inputFiles()) <= 3
    plain, few = (Engine(e).rows(ask, strict=False).select("alignment_id", "release_id").collect() for e in (whole, some))
    assert sorted(plain) == sorted(few) != []
    either = q._query({"or": [q.p("root", "the"), q.p("pos", "N")]})
    assert len(skipping.evidence_for(spark, path, index, either).inputFiles()) == len(whole.inputFiles())
    assert skipping.evidence_for(spark, path, index, q._query(q.p("root", "none such"))).count() == 0


def test_bitmaps_merge_to_exact_counts(spark):
    rows = [(g, h, (g * 7919 + k * 104729) % 100_003 if k % 9 else None) for g in range(4) for h in ("x", None) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, h string, id long").repartition(3)
    made = bitmaps.bitmaps(df, "id", "g", "h")
    for groups in (("g", "h"), ("g",), ("h",), ()):
        want = {tuple(r)[:-1]: r["n"] for r in df.groupBy(*groups).agg(F.count_distinct("id").alias("n")).collect()}
        assert {tuple(r)[:-1]: r["n"] for r in bitmaps.counts(made, *groups).collect()} == want


def test_bitmaps_of_small_groups_are_small(spark):
    """A group of one identity is one word of 64 bits, not a bucket of 4 kB; negative and far identities, and texts, count too."""
    ids = [-(1 << 40), -1, 0, 63, 64, 1 << 50]
    df = spark.createDataFrame([(k, i, str(i)) for k, i in enumerate(ids)] + [(9, 64, "64"), (9, None, None)], "g int, id long, name string")
    made = bitmaps.bitmaps(df, "id", "g")
    assert made.schema["bits"].dataType.typeName() == "long" and made.count() == 7
    for identity in ("id", "name"):
        made = bitmaps.bitmaps(df, identity, "g")
        assert bitmaps.counts(made).first()["n"] == 6 and {r["g"]: r["n"] for r in bitmaps.counts(made, "g").collect()} == {k: 1 for k in (0, 1, 2, 3, 4, 5, 9)}


def test_rows_in_conflict_meet_conflicts_only(spark, capsys):
    """As `conflicting` of `with_conflicts`, but few conflicts are sent to the rows, which are not shuffled."""
    rows = spark.range(400).selectExpr("id as alignment_id", "if(id % 10 = 0, null, id % 50) as token_id", "'aligned' as status")
    told = spark.range(400).selectExpr("if(id % 10 = 0, null, id % 50) as token_id", "if(id % 50 < 5, cast(id as string), 'l') as lemma", "if(id % 50 = 3, cast(id as string), '') as root", "'V' as pos")
    for dimension in (None, "root", "pos"):
        want = alignment.conflicting(alignment.with_conflicts(rows, told), dimension)
        got = alignment.in_conflict(rows, told, dimension).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and (got.count() > 0) == (dimension != "pos")
    assert "Exchange hashpartitioning" not in plan(got, capsys)


def test_words_are_counted_by_batch(spark):
    units = spark.createDataFrame([("á b　b\x1cc",), (None,), ("",), (" b ",)], "text string")
    tokens = tx.tokenize(units.where("text is not null"), "text")
    for profile in (None, "remove_combining_marks_v1"):
        want = sorted(map(tuple, search.frequency(tokens, profile).collect()))
        assert sorted(map(tuple, search.word_frequency(units, profile=profile).collect())) == want != []


def test_ngrams_carry_words_only_and_count_in_one_shuffle(spark, capsys):
    rows = spark.createDataFrame([(1, i, w, "a long text") for i, w in enumerate("a b a b a b".split(), 1)], "unit int, token_no int, surface string, unit_text string")
    found = search.repeated_ngrams(rows, 2, ["unit"], cross_unit=True, locations=True)
    assert sorted((r["gram"], r["n"], [x["token_no"] for x in r["locations"]]) for r in found.collect()) == [("a b", 3, [1, 3, 5]), ("b a", 2, [2, 4])]
    capsys.readouterr()
    found.explain("formatted")
    text = capsys.readouterr().out
    assert "unit_text" not in text and "SortMergeJoin" not in text


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_running_sums_shuffle_once(spark, capsys):
    rows = spark.createDataFrame([(i, i % 7, None if i % 5 == 0 else f"w{i}") for i in range(3000)], "at int, n int, text string").repartition(5)
    out = stream.running(rows, ["at"], {"before": F.when(F.col("n") > 0, F.col("n")), "place": F.lit(1)})
    got = sorted(out.collect())
    assert [r["place"] for r in got] == list(range(3000)) and [r["before"] for r in got] == [sum(k % 7 for k in range(i)) for i in range(3000)]
    assert all(r["text"] == (None if r["at"] % 5 == 0 else f"w{r['at']}") for r in got)
    assert "Window" not in plan(out, capsys) and stream.running(rows.limit(0), ["at"], {"before": F.lit(1)}).count() == 0


def test_staged_alignment_builds_no_table_at_the_driver(spark, capsys):
    rows = spark.range(5).selectExpr("id as segment_id", "1L as collection_no", "1L as unit_no", "id as token_no", "cast(null as long) as segment_no", "cast(id as string) as form")
    tokens = rows.selectExpr("segment_id as token_id", "collection_no", "unit_no", "token_no", "form as surface")
    text = plan(alignment.align_staged(rows, tokens), capsys)
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") >= 2


def test_digests_add_lanes_without_decimals(spark, capsys, monkeypatch):
    """The same digest as sums of decimals give, and no text of a lane is made a number for each row."""
    df = spark.range(500).selectExpr("id", "cast(id % 7 as string) as w", "if(id % 3 = 0, null, cast(cast(id as string) as binary)) as b").repartition(3)
    made = df.select(digests.row_digest(*df.columns).alias("_row"))
    row = made.agg(F.count(F.lit(1)).alias("n"), *digests.lanes(F.col("_row"))).first()
    text = ",".join([str(row["n"]), *(f"{int(row[f'_{i}']) % digests.SPAN:016x}" for i in range(digests.LANES))])
    monkeypatch.setattr(digests, "lanes", None)
    assert digests.table_digest(df) == hashlib.sha256(text.encode()).hexdigest()


def test_locators_are_read_without_lambdas(spark, capsys):
    cases = ["1:2:3", "1:2:3:4", "01:2:3", "0:2:3", "1:2:0", "1:2:3:0", "1:2:3:99999999999", "99999999999:2:3", "1:2", "1:2:3:4:5", "1:2:3:", ":1:2:3", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "l string").select(features.locator(F.col("l")).alias("p"))
    assert [tuple(r["p"]) if r["p"] else None for r in df.collect()] == [(1, 2, 3, None), (1, 2, 3, 4), (1, 2, 3, None), None, None, None, (1, 2, 3, None), *[None] * 7]
    assert "lambda" not in plan(df, capsys)


def test_repeated_features_keep_the_last(spark):
    rows = spark.createDataFrame([("A=1|B=2|A=3|bare",), ("A=1|B=2|bare|",), ("",), (None,)], "f string")
    assert [r[0] for r in rows.select(features.synthetic_features(F.col("f"))).collect()] == [{"A": "3", "B": "2", "bare": "true"}, {"A": "1", "B": "2", "bare": "true"}, {}, None]

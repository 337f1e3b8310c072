import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import cli, export, provenance
from corpusloom.functions import features, normalize
from corpusloom.functions import text as tx
from corpusloom.operators import alignment, search
from corpusloom.plans import ast, projections, scope
from corpusloom.plans.engine import Engine
from corpusloom.queries import evidence
from corpusloom.sources import annotations, corpus, lines

ROOT = {"dimension": "root", "operator": "eq", "value": "the"}


def test_lines_keep_every_byte(spark, tmp_path):
    raw = b"# copyright x\r\n1|1| alpha beta\n1|2|gamma\xcc\x81 delta|more\r2|1|\n\n0|1|x\n@odd\n1|2|again"
    (tmp_path / "c.txt").write_bytes(raw)
    (tmp_path / "empty.txt").write_bytes(b"")
    got = lines.read_lines(spark, str(tmp_path / "*.txt"))
    rows = got.orderBy("line_no").collect()
    assert [r["ending"] for r in rows] == ["\r\n", "\n", "\r", "\n", "\n", "\n", "\n", ""]
    assert "".join(r["content"] + r["ending"] for r in rows).encode() == raw
    assert [(r["byte_start"], r["byte_end"]) for r in rows][1] == (15, 31)
    assert lines.rebuilt(got).first()["sha256"] == __import__("hashlib").sha256(raw).hexdigest()
    parsed = corpus.parse_lines(got)
    d = corpus.diagnostics(parsed)
    assert d["classes"] == {"license": 1, "unit_record": 4, "blank": 1, "malformed": 1, "unknown": 1}
    assert (d["duplicates"], d["empty_text"], d["failed"], d["reversals"]) == (1, 1, True, 1)
    assert corpus.units(parsed).where("unit_no = 2").orderBy("line_no").first()["text"] == "gammá delta|more"
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path), "other")


def test_v04_records(spark, tmp_path):
    body = ["# copyright synthetic", "# comment", "", annotations.HEADER, "(1:2:3:4)\tform\tTAG\tPOS:N|POS:V|FUTURE|X:one:two|ROOT:ktb", "(0:2:3:4)\tf\tT\tPOS:N", "(1:2:3:4)\tonly", "@structural"]
    (tmp_path / "a.tsv").write_bytes("\r\n".join(body).encode())
    rows = annotations.read_v04(spark, str(tmp_path / "a.tsv")).orderBy("line_no").collect()
    assert [r["parse_status"] for r in rows] == ["unknown"] * 4 + ["parsed", "malformed", "malformed", "unknown"]
    assert [r["kind"] for r in rows][:4] == ["copyright", "comment", "blank", "header"]
    assert rows[5]["parse_error"] == "invalid locator" and rows[6]["parse_error"].startswith("exactly four")
    assert rows[4]["features"]["native"] == {"POS": "V", "X": "one:two", "ROOT": "ktb"} and rows[4]["root"] == "ktb"
    assert rows[4]["features"]["fragments"][:2] == ["POS:N", "POS:V"] and rows[4]["address"]["segment"] == 4


def test_synthetic_records(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# c\n@x\n1:1:1\ta\tt\tN\t\troot\tCASE=GEN|bare||CASE=NOM\t\n1:x\ta\n")
    rows = annotations.read_synthetic(spark, str(tmp_path / "s.tsv")).orderBy("line_no").collect()
    assert [r["kind"] for r in rows] == ["comment", "unknown", "analysis", "malformed"]
    assert rows[2]["features"] == {"CASE": "NOM", "bare": "true"} and rows[2]["lemma"] is None and rows[2]["variant"] == 1


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85　ab́é😀", max_size=12), min_size=40, max_size=40))
def test_tokenizer_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["toks"] for r in df.select("id", tx.token_structs(F.col("text")).alias("toks")).collect()}
    rows = tx.tokenize(df, "text", "id").collect()
    for i, t in enumerate(texts):
        assert [x["surface"] for x in got[i]] == t.split()
        assert [t[x["start"] : x["end"]] for x in got[i]] == t.split()
        mine = sorted((r["token_no"], r["start"], r["end"], r["delimiter_before"]) for r in rows if r["id"] == i)
        assert mine == [(x["token_no"], x["start"], x["end"], x["delimiter_before"]) for x in got[i]]


def test_unicode_and_normalization(spark):
    df = spark.createDataFrame([(1, "á أَۖx"), (2, ""), (3, None)], "id long, text string")
    assert [r["value"] for r in tx.graphemes(df, "text", "id").where("id = 1").orderBy("grapheme_no").collect()][0] == "á"
    dim = {r["character"]: r for r in tx.unicode_dimension(spark, tx.codepoints(df, "text", "id")).collect()}
    assert dim["́"]["category"] == unicodedata.category("́") and dim["ۖ"]["is_annotation"]
    got = {p: df.where("id = 1").select(normalize.normalize(F.col("text"), p)).first()[0] for p in normalize.profiles()}
    assert got["base_arabic_letters_v1"] == "a اx" and got["remove_combining_marks_v1"] == "a أx"
    told = normalize.explain_value("أَ", "base_arabic_letters_v1", [101, 102])
    assert (told["value"], told["mapping"]) == ("ا", [[101]]) and {"replace", "drop"} <= {x["action"] for x in told["log"]}
    with pytest.raises(ValueError):
        normalize.profile("none")
    loc = spark.createDataFrame([("1:2:3",), ("1:2:3:4",), ("0:1:1",), ("a:b:c",), (None,)], "l string").select(features.locator(F.col("l")).alias("x")).collect()
    assert [r["x"] is not None for r in loc] == [True, True, False, False, False]


def test_alignment_decisions(spark):
    seg = spark.createDataFrame([(1, 1, 1, 1, "ab"), (2, 1, 1, 2, "أ"), (3, 9, 9, 9, "x"), (4, 1, 1, 3, "y"), (5, 1, 1, 1, "a")], "segment_id long, collection_no long, unit_no long, token_no long, form string")
    tok = spark.createDataFrame([(10, 1, 1, 1, "ab"), (11, 1, 1, 2, "ا"), (12, 1, 1, 3, "y"), (13, 1, 1, 3, "y")], "token_id long, collection_no long, unit_no long, token_no long, surface string")
    got = alignment.align(seg, tok)
    found = sorted((r["segment_id"], r["method"], r["confidence"]) for r in got.collect())
    assert found == [(1, "DIRECT", 1.0), (2, "NORMALIZED", 0.95), (3, "UNMATCHED", 0.0), (4, "AMBIGUOUS", 0.0), (4, "AMBIGUOUS", 0.0), (5, "DIRECT", 1.0)]
    alignment.check_partition(got, 5)
    with pytest.raises(RuntimeError):
        alignment.check_partition(got, 6)


def test_substring_overlaps(spark):
    df = spark.createDataFrame([("anananx",), ("xx",), ("",), ("a.a.a",)], "t string")
    assert [r[0] for r in df.select(search.occurrences(F.col("t"), "ana")).collect()] == [[0, 2], [], [], []]
    assert [r[0] for r in df.select(search.occurrences(F.col("t"), "a.a")).collect()] == [[], [], [], [0, 2]]
    with pytest.raises(ValueError):
        search.phrase(df, " ", ["t"])


def test_requests():
    a, b = ast.parse({"and": [ROOT, {"and": [ROOT, {"dimension": "surah", "operator": "in", "value": [2, 1]}]}]}), ast.parse({"and": [{"dimension": "collection", "operator": "in", "value": [2, 1]}, ROOT]})
    assert a.canonical() == b.canonical()
    query = ast.Query(a)
    assert ast.Query.from_dict(ast.load(ast.dump(query.to_dict(), "yaml"), "yaml")) == query
    codes = {
        "unsupported_dimension": lambda: ast.Predicate("juz", "eq", 1), "invalid_research_query": lambda: ast.Query(a, 501),
        "unsupported_count_unit": lambda: ast.Aggregate.from_dict({"query": query.to_dict(), "unit": "MATCH_ROW", "metric": "MIN"}),
        "unsupported_metric": lambda: ast.Aggregate(query, "MATCH_ROW", "MIN"), "excessive_group_dimensions": lambda: ast.Aggregate(query, "MATCH_ROW", group_by=("root", "pos", "lemma", "unit")),
        "unsupported_group_dimension": lambda: ast.Aggregate(query, "MATCH_ROW", group_by=("nope",)), "unbounded_aggregation": lambda: ast.Aggregate(query, "MATCH_ROW", limit=0),
        "incompatible_identity_unit": lambda: ast.SetRequest(query, query, "MATCH_ROW", "UNION"), "invalid_cooccurrence_scope": lambda: ast.Cooccurrence(query, query, scope="PAGE"),
    }
    for code, make in codes.items():
        with pytest.raises(ast.RequestError) as e:
            make()
        assert e.value.code == code
    for bad in ({}, {"and": []}, {"not": [ROOT, ROOT]}, {"xor": [ROOT]}, {"dimension": "root", "operator": "contains", "value": "x"}, {"dimension": "unit", "operator": "eq", "value": 0}):
        with pytest.raises(ast.RequestError):
            ast.parse(bad)


def test_scope_and_lifecycle():
    both = {1: "qac-morphology-v0.4", 2: "other"}
    for releases, where, code in ((both, ROOT, "source_selection_required"), ({}, ROOT, "no_registered_adapter"), ({2: "other"}, ROOT, "unknown_adapter")):
        with pytest.raises(ast.RequestError) as e:
            scope.resolve(releases, scope.requested_releases(ast.parse(where)), scope.required(ast.Query(ast.parse(where))))
        assert e.value.code == code
    release = {"dimension": "source_release", "operator": "eq", "value": 1}
    assert scope.requested_releases(ast.parse({"and": [ROOT, release]})) == (1,)
    with pytest.raises(ast.RequestError) as e:
        scope.requested_releases(ast.parse({"or": [ROOT, release]}))
    assert e.value.code == "ambiguous_source_selection"
    few = scope.Registry([scope.Adapter("few", frozenset({scope.Capability.MORPHOLOGY}))])
    with pytest.raises(ast.RequestError) as e:
        scope.resolve({1: "few"}, (), scope.required(ast.Query(ast.parse(ROOT))), few)
    assert e.value.code == "unsupported_capability"
    assert scope.transitions(scope.Lifecycle.RETIRED) == frozenset() and scope.Lifecycle.ACTIVE in scope.transitions(scope.Lifecycle.INGESTED)
    with pytest.raises(ast.RequestError):
        scope.CatalogSource("x", scope.Lifecycle.ACTIVE).guard("ingest")


def test_engine_results(spark):
    e = Engine(evidence(spark, "/root/testdata/sf0.001"), {1: "qac-morphology-v0.4"})
    query = ast.Query(ast.parse(ROOT), limit=5)
    got = e.execute(query)
    assert got["returned"] == 5 and got["truncated"] and got["total"] > 5
    left, right = ast.Query(ast.parse(ROOT)), ast.Query(ast.parse({"dimension": "pos", "operator": "eq", "value": "N"}))
    n = {o: e.set(ast.SetRequest(left, right, "CANONICAL_UNIT", o, 1000)) for o in ast.OPERATIONS}
    u = n["UNION"]
    assert u["result"] == u["left_count"] + u["right_count"] - u["overlap"] and n["INTERSECTION"]["result"] == u["overlap"]
    assert n["SYMMETRIC_DIFFERENCE"]["result"] == u["result"] - u["overlap"] and len(u["ids"]) == u["result"]
    none = ast.Query(ast.parse({"dimension": "root", "operator": "eq", "value": "nosuch"}))
    empty = e.set(ast.SetRequest(none, right, "CANONICAL_UNIT", "INTERSECTION", evidence_samples=3))
    assert empty["ids"] == [] and empty["evidence"] == []
    one = e.aggregate(ast.Aggregate(left, "CANONICAL_TOKEN", group_by=("feature",), limit=3, evidence_samples=2))
    assert len(one["groups"]) == 3 and max(r["rank"] for r in one["evidence"]) <= 2
    co = e.cooccurrence(ast.Cooccurrence(left, right, limit=3))
    assert co["pairs"] == e.pairs(ast.Cooccurrence(left, right)).count() and co["truncated"]
    assert e.explain(ast.Cooccurrence(left, right))["stages"][-1] == "page"


def test_hashes_exports_and_cli(spark, tmp_path, capsys):
    rows = [{"a": 1, "b": [1, 2], "query_hash": "x"}, {"a": 2, "b": None, "query_hash": "x"}]
    assert provenance.evidence_hash(rows) == provenance.evidence_hash([r | {"query_hash": "y"} for r in reversed(rows)])
    assert provenance.ngram_hash(["a b", "c"], "raw", 2) != provenance.ngram_hash(["a", "b c"], "raw", 2)
    assert export.render({"matches": []}, "csv") == "\n"
    for fmt in ("json", "jsonl", "csv"):
        path = tmp_path / f"x.{fmt}"
        export.write_export(rows, path, fmt)
        assert export.verify_export(path)["ok"]
        path.write_text(path.read_text() + " ")
        assert not export.verify_export(path)["ok"]
    for fmt in ("text", "json", "yaml", "csv", "jsonl", "markdown"):
        assert export.render({"matches": rows}, fmt) == export.render({"matches": rows}, fmt)
    evidence(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "ev"))
    ask = json.dumps({"schema": "research-aggregation-v1", "query": {"where": ROOT}, "unit": "CANONICAL_AYAH", "group_by": ["surah"], "limit": 2})
    assert cli.main(["research", str(tmp_path / "ev"), ask]) == 0
    assert len(json.loads(capsys.readouterr().out)["groups"]) == 2
    assert cli.main(["research", str(tmp_path / "ev"), '{"where": {}}']) == 2
    assert json.loads(capsys.readouterr().err)["code"] == "invalid_research_query"


def test_staged_rules(spark):
    """A missing token ends the search; equality goes before marks, marks before candidates of the unit."""
    seg = spark.createDataFrame(
        [(1, 1, 1, 9, None, "ab"), (2, 1, 1, 1, None, "ab"), (3, 1, 1, 1, 2, "ab"), (4, 1, 1, 2, 1, "c"), (5, 1, 1, 1, None, "ć"), (6, 1, 1, 1, None, "d"), (7, 1, 1, 1, None, "zz"), (8, None, None, None, None, "ab")],
        "segment_id long, collection_no long, unit_no long, token_no long, segment_no int, form string",
    )
    tok = spark.createDataFrame([(10, 1, 1, 1, "ab"), (11, 1, 1, 2, "ć"), (12, 1, 1, 3, "d"), (13, 1, 1, 4, "d")], "token_id long, collection_no long, unit_no long, token_no long, surface string")
    got = {r["segment_id"]: (r["rule"], r["status"], r["confidence"], r["token_id"]) for r in alignment.align_staged(seg, tok).collect()}
    assert got == {
        1: ("missing_locator", "unaligned", 0.0, None), 2: ("exact_token", "aligned", 1.0, 10), 3: ("segment_exact", "aligned", 1.0, 10), 4: ("normalized_token", "partial", 0.9, 11),
        5: ("bounded_candidate", "partial", 0.6, 11), 6: ("bounded_candidate", "ambiguous", 0.0, None), 7: ("surface_mismatch", "unaligned", 0.0, None), 8: ("invalid_locator", "unaligned", 0.0, None),
    }


def test_equal_requests_hash_alike_and_errors_name_their_cause():
    a, b = (ast.Query(ast.parse({"and": x})) for x in ([ROOT, {"dimension": "unit", "operator": "eq", "value": 1}], [{"dimension": "ayah", "operator": "eq", "value": 1}, ROOT]))
    for make in (lambda q: q, lambda q: ast.Aggregate(q, "MATCH_ROW"), lambda q: ast.SetRequest(q, q, "CANONICAL_UNIT", "UNION"), lambda q: ast.Cooccurrence(q, q)):
        assert Engine.result("x", make(a), {})["reproducibility_hash"] == Engine.result("x", make(b), {})["reproducibility_hash"]
    assert ast.Aggregate(a, "MATCH_ROW").limit == 50
    for code, make in (
        ("unsupported_dimension", lambda: ast.Predicate("nope", "eq", "x")), ("unsupported_group_dimension", lambda: ast.Aggregate(a, "MATCH_ROW", group_by=("root", "root"))),
        ("unsupported_metric", lambda: ast.Aggregate(a, "MATCH_ROW", order="up")),
    ):
        with pytest.raises(ast.RequestError) as e:
            make()
        assert e.value.code == code
    assert scope.Capability.SOURCE_LOCATOR in scope.required(a, unit="CANONICAL_TOKEN")
    told = scope.scope_metadata({1: "x", 2: "y"}, [1, 9], [1])
    assert told == {"requested": [1, 9], "effective": [1], "excluded": [2], "rejected": [9], "adapters": ["x"]}
    with pytest.raises(ast.RequestError):
        scope.same_adapters({1: "x", 2: "y"}, [1], [2])
    assert scope.adapter_of({"format": "f"}, {"f": "x"}) == "x"


def test_numbers_in_any_script_and_morphology_filters(spark):
    rows = spark.createDataFrame([("١٢|٣|text|more",), ("0|1|x",), ("a|b|c",)], "content string")
    got = corpus.parse_lines(rows).collect()
    assert (got[0]["collection_no"], got[0]["unit_no"], got[0]["text"]) == (12, 3, "text|more") and got[1]["record_type"] == "malformed"
    for bad in ({}, {"root": "x", "limit": 501}, {"collection": 0}, {"method": "GUESSED"}):
        with pytest.raises(ValueError):
            projections.MorphologyQuery(**bad)
    assert provenance.canonical_json({"t": __import__("datetime").datetime(2020, 1, 2, 3, 4, 5, 678)}) == '{"t":"2020-01-02T03:04:05Z"}'


def test_tokens_leave_in_small_batches(spark, monkeypatch):
    """Neither many texts nor a long one make a large batch."""
    import pyarrow as pa

    units = spark.createDataFrame([(1, "a")], "unit_id long, text string")
    held = []
    monkeypatch.setattr(type(units), "mapInArrow", lambda self, f, schema: held.append(f))
    tx.tokenize(units, "text", "unit_id")
    texts = ["ab " * 40_000, None, *(["c de"] * 9_998)]
    out = list(held[0](iter([pa.record_batch([pa.array(range(10_000), pa.int64()), pa.array(texts)], names=["unit_id", "_text"])])))
    assert max(b.num_rows for b in out) <= 1 << 15
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 40_000 + 2 * 9_998
    assert rows[39_999] == {"unit_id": 0, "token_no": 40_000, "surface": "ab", "delimiter_before": " ", "start": 119_997, "end": 119_999}
    assert rows[-1] == {"unit_id": 9_999, "token_no": 2, "surface": "de", "delimiter_before": " ", "start": 2, "end": 4}

"""Run log, registration, entity exports, and the diagnostics that make only what is missing."""

import hashlib
import json
import unicodedata
from collections import Counter

import pytest

from corpusloom import cli, export, runs
from corpusloom.functions import text as tx
from corpusloom.queries import evidence
from corpusloom.sources import corpus, register


def test_runs_are_written_once_and_verified(spark, tmp_path):
    log = runs.RunLog(tmp_path / "runs", spark)
    first = log.start("search", {"sha256": "x"}, {}, {"value": "the", "limit": 5}, allow_dirty=True)
    other = log.start("search", {"sha256": "x"}, {}, {"value": "the", "limit": 9}, allow_dirty=True)
    assert (first["id"], other["id"], first["status"]) == (1, 2, "running")
    assert first["query_hash"] == other["query_hash"], "paging does not change a query"
    assert not log.verify(1)["ok"]
    rows = [{"token": "a b", "place": [1, 2], "none": None}, {"token": "c", "place": [3], "none": None}]
    done = log.finish(1, rows)
    assert (done["status"], done["result_count"]) == ("completed", 2) and log.results(1) == rows and log.verify(1)["ok"]
    for again in (lambda: log.finish(1, []), lambda: log.fail(1, "late"), lambda: log.run(7), lambda: log.export(2, tmp_path / "e", "json")):
        with pytest.raises(ValueError):
            again()
    assert log.fail(2, "lost")["error"] == "lost"
    assert log.export(1, tmp_path / "e.jsonl", "jsonl")["run_id"] == 1 and export.verify_export(tmp_path / "e.jsonl")["ok"]
    path = tmp_path / "runs" / "run-1.results.jsonl"
    path.write_text(path.read_text().replace('"c"', '"d"'))
    assert not log.verify(1)["evidence"]


def test_dirty_trees_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "environment", lambda spark: {"git_dirty": True})
    with pytest.raises(ValueError):
        runs.RunLog(tmp_path).start("search", {}, {}, {})
    assert list(tmp_path.iterdir()) == []


def test_corpus_store(spark, tmp_path):
    raw = b"# note\n1|1|alpha\r\n1|2|" + unicodedata.normalize("NFD", "é").encode() + b"\n"
    (tmp_path / "c.txt").write_bytes(raw)
    got = register.register_corpus(spark, tmp_path / "c.txt", tmp_path / "store", "My Corpus!", "1.0")
    m = got["manifest"]
    assert got["status"] == "registered" and m["sha256"] == hashlib.sha256(raw).hexdigest() and m["lines"] == 3
    assert (m["is_normalized_NFC"], m["is_normalized_NFD"]) == (False, True)
    stored = tmp_path / "store" / "raw" / f"my-corpus_1.0_pipe-ayah-v1_{m['sha256']}.txt"
    assert stored.read_bytes() == raw
    assert register.register_corpus(spark, tmp_path / "c.txt", tmp_path / "store", "My Corpus!", "1.0")["status"] == "already_registered"
    stored.write_bytes(b"other")
    with pytest.raises(RuntimeError):
        register.register_corpus(spark, tmp_path / "c.txt", tmp_path / "store", "My Corpus!", "1.0")
    (tmp_path / "bad.txt").write_bytes(b"1|1|a\n1|1|b\n")
    assert register.register_corpus(spark, tmp_path / "bad.txt", tmp_path / "no", "b", "1")["status"] == "rejected"
    assert not (tmp_path / "no").exists()


def test_annotation_ledger(spark, tmp_path):
    raw = b"(1:1:1:1)\tf\tT\tPOS:N\r\n# x"
    (tmp_path / "a.tsv").write_bytes(raw)
    add = lambda name, **kw: register.register_annotations(spark, tmp_path / "a.tsv", tmp_path / "ledger", name, "0.4", "v04", **kw)
    got = add("n")
    assert got["status"] == "registered" and (got["entry"]["lines"], got["entry"]["newlines"], got["entry"]["bytes"]) == (2, "crlf", len(raw))
    assert add("n", sha256=got["entry"]["sha256"], sha512=got["entry"]["sha512"])["status"] == "already_registered"
    for call in (lambda: add("other"), lambda: add("n", sha256="0")):
        with pytest.raises(ValueError):
            call()
    assert register.newline_style({"\n", "\r\n", ""}) == "mixed" and register.newline_style({""}) == "none"


@pytest.mark.parametrize("fmt", ["jsonl", "csv"])
def test_entity_exports(spark, tmp_path, fmt):
    aligned = spark.createDataFrame([(1, "direct", ["a"]), (2, "ambiguous", None), (3, "conflict", ['q"\n,'])], "id long, status string, of array<string>")
    tables = {"alignment": aligned, "records": aligned, "analyses": aligned, "segments": aligned, "validation": aligned.limit(0)}
    count = {}
    for entity in export.entities(tables):
        path = f"{tmp_path}/{entity}"
        count[entity] = export.export_entity(tables, entity, path, fmt)["rows"]
        assert export.verify_entity(spark, path)["ok"]
    assert count == {"alignments": 3, "source-records": 3, "analyses": 3, "segments": 3, "unresolved": 2, "conflicts": 1, "validation": 0}
    part = next(p for p in (tmp_path / "conflicts").glob("part-*") if "conflict" in p.read_text())
    part.write_text(part.read_text().replace("conflict", "direct"))
    (part.parent / f".{part.name}.crc").unlink()
    assert not export.verify_entity(spark, f"{tmp_path}/conflicts")["digest"]
    for bad in (lambda: export.export_entity(tables, "tokens", f"{tmp_path}/x", fmt), lambda: export.export_entity(tables, "segments", f"{tmp_path}/x", "xml")):
        with pytest.raises(ValueError):
            bad()


def test_gaps_and_inventory(spark):
    rows = spark.createDataFrame([(1, 3), (1, 3), (1, 6), (2, 1), (2, 2), (3, None), (4, -2), (None, 2)], "c int, u int")
    assert sorted(map(tuple, corpus.gaps(rows, "c", "u").collect()), key=str) == sorted([(1, 4), (1, 5)], key=str)
    texts = ["aé😀a", "", None, "\0\n" * 3, "z" * 5_000_000]
    found = tx.codepoint_inventory(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = Counter("".join(t for t in texts if t))
    assert {(r["codepoint"], r["character"], r["n"]) for r in found} == {(f"U+{ord(c):04X}", c, n) for c, n in want.items()}
    assert tx.codepoint_inventory(spark.createDataFrame([], "text string")).count() == 0


def test_run_files_hold_canonical_json(spark, tmp_path):
    log = runs.RunLog(tmp_path)
    log.finish(log.start("count", {}, {}, {}, allow_dirty=True)["id"], [])
    assert json.loads((tmp_path / "run-1.completed.json").read_text())["result_count"] == 0 and log.verify(1)["ok"]


def run_cli(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    got = capsys.readouterr()
    return code, [json.loads(x) for x in (got.out or got.err).split("\n") if x]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_bytes(b"1|1|la la no\n1|2|no la la\n2|1|l\xcc\x81a")
    c = tmp_path / "c.txt"
    assert [r["token_no"] for r in run_cli(capsys, "search", "exact", c, "la")[1]] == [1, 2, 2, 3]
    assert len(run_cli(capsys, "search", "normalized", c, "la", "--profile", "remove_combining_marks_v1")[1]) == 5
    assert [(r["unit_no"], r["start"]) for r in run_cli(capsys, "search", "substring", c, "a l")[1]] == [(1, 1), (2, 4)]
    assert [r["unit_no"] for r in run_cli(capsys, "search", "phrase", c, "la la")[1]] == [1, 2]
    assert run_cli(capsys, "count", c, "--limit", "1")[1] == [{"n": 4, "value": "la"}]
    assert [(r["gram"], r["n"]) for r in run_cli(capsys, "ngrams", c, "2")[1]] == [("la la", 2)]
    assert run_cli(capsys, "unit", c, "1", "2")[1][0]["text"] == "no la la"
    assert run_cli(capsys, "token", c, "1", "1", "3")[1][0]["surface"] == "no"
    assert len(run_cli(capsys, "tokens", c)[1]) == 7
    assert run_cli(capsys, "normalization", "list")[1][0] and run_cli(capsys, "normalization", "show", "remove_combining_marks_v1")[1][0]["immutable"]
    assert run_cli(capsys, "normalization", "compare", "la\u0301", "--profile", "remove_combining_marks_v1")[1][0] == {"changed": True, "input": "la\u0301", "value": "la"}
    assert run_cli(capsys, "search", "exact", c, "la", "--limit", "0")[0] == 2
    assert run_cli(capsys, "search", "normalized", c, "la", "--profile", "none_such")[0] == 2
    assert run_cli(capsys, "register", c, tmp_path / "store", "n", "1")[0] == 0
    (tmp_path / "bad.txt").write_bytes(b"1|x|y")
    assert run_cli(capsys, "register", tmp_path / "bad.txt", tmp_path / "store", "n", "1")[0] == 1
    log = tmp_path / "runs"
    assert run_cli(capsys, "search", "exact", c, "la", "--runs", log, "--allow-dirty")[0] == 0
    assert run_cli(capsys, "verify-run", log, "1")[1][0]["ok"]
    evidence(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "ev"))
    assert all(r["pos"] == "P" for r in run_cli(capsys, "morphology", tmp_path / "ev", "--pos", "P", "--limit", "3")[1])
    assert run_cli(capsys, "morphology", tmp_path / "ev")[0] == 2
    assert {r["value"] for r in run_cli(capsys, "stats", tmp_path / "ev", "parser-status")[1]} == {"parsed", "malformed"}

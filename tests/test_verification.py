"""Contracts of sources and records; goldens, locks, manifests and certificates."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom import verification as v
from corpusloom.plans.engine import Engine
from corpusloom.queries import evidence
from corpusloom.sources import annotations, contracts

SOUND = {
    "identity": {"source_identifier": "s", "source_class": "synthetic-fixture", "adapter_identifier": "a", "adapter_version": "1"},
    "acquisition": {"acquisition_date": "2020-01-02", "local_filename": "l", "original_filename": "o"},
    "integrity": {"license": "x", "citation": "y", "fingerprint": {"sha256": "a" * 64, "byte_count": 3}},
    "parser_configuration": {"parser_identifier": "p", "parser_version": "1"},
}


def test_metadata():
    assert contracts.metadata_faults(SOUND) == [] and len(contracts.metadata_hash(SOUND)) == 64
    bad = SOUND | {"identity": SOUND["identity"] | {"adapter_version": "", "source_class": "web"}, "integrity": {"fingerprint": {"sha256": "A" * 64, "sha512": "0", "byte_count": -1}}}
    assert len(contracts.metadata_faults(bad)) == 5
    assert len(contracts.metadata_faults({})) == 7 + 1 + 1 + 1 + 1
    with pytest.raises(ValueError):
        contracts.metadata_hash(bad)
    a, b = (contracts.configuration_hash("p", "1", o) for o in ({"x": 1, "y": 2}, {"y": 2, "x": 1}))
    assert a == b and a["algorithm"] == "sha256-canonical-json-v1" and a != contracts.configuration_hash("p", "1")


def test_records(spark, tmp_path):
    raw = "# copyright\r\n(1:2:3:4)\tform\tT\tPOS:N\n\n(1:2:3:4)\tonly\n@odd".encode()
    (tmp_path / "a.tsv").write_bytes(raw)
    (tmp_path / "b.tsv").write_bytes(b"")
    records = annotations.read_v04(spark, str(tmp_path))
    assert contracts.record_faults(records).count() == 0 and contracts.file_faults(records).count() == 0
    prints = annotations.fingerprint(spark, str(tmp_path))
    assert sorted(r["faithful"] for r in contracts.faithful(records, prints).collect()) == [True]
    empty = spark.createDataFrame([("b.tsv", 0, "e"), ("c.tsv", 1, "e")], prints.select("path", "bytes", "sha256").schema)
    assert [r["faithful"] for r in contracts.faithful(records, empty).orderBy("path").collect()] == [True, False]
    assert hashlib.sha256(raw).hexdigest() in {r["sha256"] for r in prints.collect()}
    faults = lambda df: sorted((r["line_no"], r["fault"]) for r in contracts.record_faults(df).collect())
    assert faults(records.withColumn("parse_status", F.lit("parsed"))) == sorted([(i, "parsed without a locator") for i in (1, 3, 4, 5)] + [(4, "error on a record that is not malformed")])
    assert (1, "unknown status") in faults(records.withColumn("parse_status", F.lit(None).cast("string")))
    assert faults(records.withColumn("ending", F.lit("")))[0] == (1, "bytes do not span the line")
    told = lambda df: [r["fault"] for r in contracts.file_faults(df).collect()]
    assert told(records.where("line_no <> 2")) == ["lines are not consecutive from 1", "bytes have gaps or overlaps"]
    assert told(records.union(records)) == ["lines are not consecutive from 1", "bytes have gaps or overlaps"]
    assert told(records.withColumn("line_no", F.col("line_no") + 1)) == ["lines are not consecutive from 1"]
    assert False in {r["faithful"] for r in contracts.faithful(records.where("line_no <> 2"), prints).collect()}


def test_goldens(spark, tmp_path, monkeypatch):
    the = {"dimension": "root", "operator": "eq", "value": "the"}
    requests = [
        {"schema": "research-query-v1", "where": the, "limit": 3}, {"schema": "research-aggregation-v1", "query": {"where": the}, "unit": "CANONICAL_TOKEN", "group_by": ["pos"]},
        {"schema": "research-set-v1", "left": {"where": the}, "right": {"where": the}, "identity": "CANONICAL_UNIT", "operation": "UNION", "limit": 4},
    ]
    write = lambda version, names: (tmp_path / "specs.json").write_text(json.dumps({"golden_version": version, "specs": [{"name": n, "request": requests[i % 3]} for i, n in enumerate(names)]}))
    write("other", v.CATEGORIES)
    with pytest.raises(v.VerificationError):
        v.Goldens(tmp_path)
    write(v.GOLDEN, v.CATEGORIES[:3])
    goldens, engine = v.Goldens(tmp_path), Engine(evidence(spark, "/root/testdata/sf0.001"))
    assert not goldens.contract()["complete"] and goldens.verify(engine)["failed"] == 3
    with pytest.raises(v.VerificationError):
        goldens.verify(engine, update=True)
    monkeypatch.setenv(*v.CONSENT)
    assert goldens.verify(engine, update=True)["passed"] == 3
    assert goldens.verify(engine)["passed"] == 3 and goldens.replay(engine)["passed"] == 3 and all(r["passed"] for r in goldens.contract()["results"])
    path = goldens.path(v.CATEGORIES[0])
    path.write_text(path.read_text() + " ")
    assert [r["passed"] for r in goldens.contract()["results"]] == [False, True, True]
    path.write_text("{")
    assert goldens.verify(engine)["failed"] == 1
    assert [w["identity"] for w in goldens.timings(engine)["workloads"]] == list(v.CATEGORIES[:3])
    assert v.stable({"metadata": {"duration_ms": 1, "kept": 2}}) == {"metadata": {"kept": 2}}


def test_locks_manifest_and_certificate(spark, monkeypatch):
    assert v.locks()["failed"] == 0
    monkeypatch.setitem(v.LOCKS, "every_field_counts", lambda: 1 / 0)
    assert [r["name"] for r in v.locks()["results"] if not r["passed"]] == ["every_field_counts"]
    one = v.manifest({1: "qac-morphology-v0.4"})
    assert one["manifest_hash"] == v.manifest({1: "qac-morphology-v0.4"})["manifest_hash"] != v.manifest({2: "qac-morphology-v0.4"})["manifest_hash"]
    first, second = v.certificate({}), v.certificate({}, {"passed": 7, "failed": 0, "warnings": 0, "status": "PASS"})
    assert first["summary"]["status"] == "NOT_RUN" and first["certificate_hash"] != second["certificate_hash"]
    assert v.table_counts({"a": spark.range(3), "b": spark.range(0)}) == {"a": 3, "b": 0} and v.table_counts({}) == {}

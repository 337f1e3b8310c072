"""Bounded, byte-stable exports with a sidecar manifest; renderers."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .provenance import canonical_hash, canonical_json, evidence_hash, file_sha256

NESTED = (list, tuple, dict)


def table_rows(payload: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The rows that a result carries."""
    for key in ("matches", "groups", "page", "rows"):
        if isinstance(payload.get(key), list):
            return [dict(r) for r in payload[key]]
    return [{"id": i} for i in payload["ids"]] if "ids" in payload else [dict(payload)]


def cell(value: Any) -> Any:
    return canonical_json(value) if isinstance(value, NESTED) else value


def csv_text(rows: list[dict[str, Any]], fields: list[str] | None = None) -> str:
    fields = fields or list(dict.fromkeys(k for r in rows for k in r))
    out = io.StringIO()
    writer = csv.DictWriter(out, fields, lineterminator="\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows({k: cell(v) for k, v in r.items()} for r in rows)
    return out.getvalue()


def render(payload: Mapping[str, Any], fmt: str) -> str:
    """text, json, yaml, csv, jsonl or markdown; nested cells are canonical JSON."""
    rows = table_rows(payload)
    if fmt == "json":
        return canonical_json(payload) + "\n"
    if fmt == "yaml":
        import yaml

        return yaml.safe_dump(json.loads(canonical_json(payload)), allow_unicode=True, sort_keys=True)
    if fmt == "jsonl":
        return "".join(canonical_json(r) + "\n" for r in rows)
    if fmt == "csv":
        return csv_text(rows)
    fields = list(dict.fromkeys(k for r in rows for k in r))
    if fmt == "markdown":
        line = lambda cells: "| " + " | ".join(str("" if c is None else c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |\n"
        return line(fields) + line("---" for _ in fields) + "".join(line(cell(r.get(f)) for f in fields) for r in rows)
    if fmt == "text":
        return "".join("\t".join(f"{f}={cell(r.get(f))}" for f in fields) + "\n" for r in rows)
    raise ValueError(f"unsupported format: {fmt}")


def write_export(rows: list[dict[str, Any]], path: Path | str, fmt: str, **about: Any) -> dict[str, Any]:
    """Write rows and `<path>.manifest.json`; CSV leaves nested fields out."""
    path = Path(path)
    flat = [{k: v for k, v in r.items() if fmt != "csv" or not isinstance(v, NESTED)} for r in rows]
    text = csv_text(flat) if fmt == "csv" else "".join(canonical_json(r) + "\n" for r in flat) if fmt == "jsonl" else canonical_json(flat) + "\n"
    path.write_text(text, encoding="utf-8", newline="")
    manifest = {"file": path.name, "format": fmt, "rows": len(rows), "sha256": file_sha256(path), "evidence_sha256": evidence_hash(rows), **about}
    Path(f"{path}.manifest.json").write_text(canonical_json(manifest) + "\n", encoding="utf-8")
    return manifest


def read_export(path: Path | str, fmt: str, integers: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    text = Path(path).read_text(encoding="utf-8")
    if fmt == "json":
        return json.loads(text)
    if fmt == "jsonl":
        return [json.loads(x) for x in text.split("\n") if x]  # texts may hold other line separators
    rows = csv.DictReader(io.StringIO(text))
    return [{k: None if v == "" else int(v) if k in integers else v for k, v in r.items()} for r in rows]


def verify_export(path: Path | str, integers: tuple[str, ...] = ()) -> dict[str, Any]:
    """File hash, row count and evidence hash against the manifest; CSV has no nested fields, so its evidence is not comparable."""
    manifest = json.loads(Path(f"{path}.manifest.json").read_text(encoding="utf-8"))
    try:
        rows = read_export(path, manifest["format"], integers)
    except ValueError:
        return {"ok": False, "readable": False}
    checks = {"sha256": file_sha256(path) == manifest["sha256"], "rows": len(rows) == manifest["rows"]}
    if manifest["format"] != "csv":
        checks["evidence"] = evidence_hash(rows) == manifest["evidence_sha256"]
    return {"ok": all(checks.values()), **checks}


#: Alignment statuses that leave a question open.
UNRESOLVED = ("ambiguous", "partial", "unaligned", "conflict")


def entities(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What can be exported of an ingestion: `tables` holds alignment, records, analyses, segments and validation."""
    aligned = tables["alignment"]
    return {
        "alignments": aligned, "source-records": tables["records"], "analyses": tables["analyses"], "segments": tables["segments"], "unresolved": aligned.where(F.col("status").isin(*UNRESOLVED)),
        "conflicts": aligned.where("status = 'conflict'"), "validation": tables["validation"],
    }


def _digest(lines: DataFrame) -> dict[str, Any]:
    """Number of lines and a sum of their hashes, the same for any order; repeated lines count."""
    one = lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return one.asDict()


def export_entity(tables: Mapping[str, DataFrame], entity: str, path: str, fmt: str = "jsonl") -> dict[str, Any]:
    """Write an entity as a folder of part files by the executors, of any size, and `<path>.manifest` beside it.

    JSON lines keep null and nested fields and are what the digest covers; CSV holds nested fields as JSON.
    """
    every = entities(tables)
    if entity not in every:
        raise ValueError(f"unknown entity: {entity}")
    if fmt not in ("jsonl", "csv"):
        raise ValueError(f"unsupported format: {fmt}")
    rows = every[entity]
    spark = rows.sparkSession
    if fmt == "jsonl":
        rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
    else:
        nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}
        rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns)).write.mode("errorifexists").csv(path, header=True, escape='"')
    manifest = {"entity": entity, "format": fmt, **_written(spark, path, fmt)}
    manifest["manifest_sha256"] = canonical_hash(manifest)
    spark.createDataFrame([(canonical_json(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")
    return manifest


def _written(spark: SparkSession, path: str, fmt: str) -> dict[str, Any]:
    """Rows of an export and, for both formats, the digest of its lines as they are in the files."""
    found = _digest(spark.read.text(path))
    return found if fmt == "jsonl" else {"rows": spark.read.csv(path, header=True, multiLine=True, escape='"').count(), "digest": found["digest"]}


def verify_entity(spark: SparkSession, path: str) -> dict[str, Any]:
    """Rows and digest of the files, and the manifest's own hash, recomputed."""
    manifest = json.loads(spark.read.text(f"{path}.manifest").first()["value"])
    got = _written(spark, path, manifest["format"])
    own = canonical_hash({k: v for k, v in manifest.items() if k != "manifest_sha256"})
    checks = {"rows": got["rows"] == manifest["rows"], "digest": got["digest"] == manifest["digest"], "manifest": own == manifest["manifest_sha256"]}
    return {"ok": all(checks.values()), **checks}

"""Registration of sources: a content-addressed store of corpora, a ledger of annotation files that are not copied."""

from __future__ import annotations

import json
import re
import shutil
import unicodedata
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..provenance import canonical_json, file_sha256
from .annotations import fingerprint
from .corpus import diagnostics, parse_lines
from .lines import LF_ONLY, read_lines

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalization_flags(lines: DataFrame) -> DataFrame:
    """One row: whether all lines are in each normalization form; true without lines.

    A line break composes with nothing, so the lines are in a form exactly where the whole text is.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            text = p["content"].dropna()
            yield pd.DataFrame({f: [all(unicodedata.is_normalized(f, t) for t in text)] for f in FORMS})

    found = lines.select("content").mapInPandas(run, ", ".join(f"{f} boolean" for f in FORMS))
    return found.agg(*(F.coalesce(F.bool_and(f), F.lit(True)).alias(f"is_normalized_{f}") for f in FORMS))


def stored_name(name: str, version: str, fmt: str, sha256: str) -> str:
    """Name of a stored file; runs of characters other than letters, digits, points, dashes and underscores become a dash."""
    safe = [re.sub(r"[^A-Za-z0-9._-]+", "-", part).strip("-").lower() for part in (name, version, fmt)]
    return "_".join([*safe, f"{sha256}.txt"])


def register_corpus(spark: SparkSession, path: Path | str, store: Path | str, name: str, version: str, fmt: str = "pipe-ayah-v1") -> dict[str, Any]:
    """Copy a sound corpus into `store` under its digest, with a manifest; a second call changes nothing.

    A corpus whose diagnostics fail is rejected; a stored file of the same name with other bytes is never replaced.
    """
    path, store = Path(path).resolve(), Path(store)
    if not path.is_file():
        raise FileNotFoundError(path)
    lines = read_lines(spark, path.as_uri())
    found = diagnostics(parse_lines(lines))
    if found["failed"]:
        return {"status": "rejected", "diagnostics": found}
    sha256 = file_sha256(path)
    target = store / "raw" / stored_name(name, version, fmt, sha256)
    status = "already_registered" if target.exists() else "registered"
    if target.exists() and file_sha256(target) != sha256:
        raise RuntimeError(f"{target.name} is stored with other bytes")
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(".part")
        shutil.copyfile(path, part)
        part.rename(target)
    manifest = {
        "name": name, "version": version, "format": fmt, "original": path.name, "stored": str(target), "sha256": sha256, "bytes": path.stat().st_size, "lines": lines.count(),
        "diagnostics": found, **normalization_flags(lines).first().asDict(),
    }
    about = store / "manifests" / f"{target.name}.manifest.json"
    about.parent.mkdir(parents=True, exist_ok=True)
    about.write_text(canonical_json(manifest) + "\n", encoding="utf-8")
    return {"status": status, "manifest": manifest}


def newline_style(endings: set[str]) -> str:
    """lf, crlf, mixed, or none; a last line without an ending does not count."""
    kinds = {"crlf" if e == "\r\n" else "lf" for e in endings if e}
    return kinds.pop() if len(kinds) == 1 else "mixed" if kinds else "none"


def register_annotations(
    spark: SparkSession, path: Path | str, ledger: Path | str, name: str, version: str, adapter: str, sha256: str | None = None, sha512: str | None = None,
) -> dict[str, Any]:
    """Record an annotation file's identity in `ledger` without copying it.

    A file that is not the one expected is refused, and so is one that is already known under another identity; the same
    registration again changes nothing.
    """
    where = Path(path).resolve()
    if not where.is_file():
        raise FileNotFoundError(where)
    one = fingerprint(spark, where.as_uri()).first()
    for kind, expected in (("sha256", sha256), ("sha512", sha512)):
        if expected is not None and expected != one[kind]:
            raise ValueError(f"{kind} of {where.name} is not the one expected")
    lines = read_lines(spark, where.as_uri(), LF_ONLY)
    endings = {r["ending"] for r in lines.select("ending").distinct().collect()}
    entry = {
        "name": name, "version": version, "adapter": adapter, "sha256": one["sha256"], "sha512": one["sha512"], "bytes": one["bytes"], "lines": lines.count(), "newlines": newline_style(endings),
    }
    at = Path(ledger) / f"{one['sha256']}.json"
    at.parent.mkdir(parents=True, exist_ok=True)
    try:
        with at.open("x", encoding="utf-8") as f:
            f.write(canonical_json(entry) + "\n")
        return {"status": "registered", "entry": entry}
    except FileExistsError:
        if json.loads(at.read_text(encoding="utf-8")) != entry:
            raise ValueError(f"{where.name} is registered under another identity") from None
        return {"status": "already_registered", "entry": entry}

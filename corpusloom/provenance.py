"""Canonical JSON, hashes, environment: what makes a result reproducible and tamper-evident."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform
import subprocess
from collections.abc import Iterable, Mapping
from datetime import UTC, date, datetime
from enum import Enum
from pathlib import Path
from typing import Any


def _plain(value: Any) -> Any:
    if isinstance(value, datetime):
        value = value.replace(microsecond=0)
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z") if value.tzinfo else value.isoformat() + "Z"
    if isinstance(value, date | Path):
        return str(value)
    if isinstance(value, Enum):
        return value.value
    if dataclasses.is_dataclass(value):
        return dataclasses.asdict(value)
    if isinstance(value, set | frozenset):
        return sorted(value)
    return str(value)


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, UTF-8."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=_plain)


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


#: Fields that vary from run to run and stay out of evidence hashes.
VOLATILE = ("id", "analysis_run_id", "query_hash")


def evidence_hash(rows: Iterable[Mapping[str, Any]]) -> str:
    """The same for any order of rows."""
    return canonical_hash(sorted(canonical_json({k: v for k, v in r.items() if k not in VOLATILE}) for r in rows))


def ngram_hash(tokens: list[str], representation: str, n: int, profile_hash: str | None = None) -> str:
    return canonical_hash({"tokens": list(tokens), "representation": representation, "n": n, "profile": profile_hash})


def query_hash(kind: str, source: Mapping[str, Any], scope: Mapping[str, Any], params: Mapping[str, Any], profile_hash: str | None = None) -> str:
    """Paging does not change what a query means."""
    kept = {k: v for k, v in params.items() if k not in ("limit", "offset")}
    return canonical_hash({"kind": kind, "source": dict(source), "scope": dict(scope), "params": kept, "profile": profile_hash})


def file_sha256(path: Path | str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def environment(spark: Any = None) -> dict[str, Any]:
    import pyspark

    dirty = _git("status", "--porcelain")
    out = {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "git_commit": _git("rev-parse", "HEAD"), "git_dirty": None if dirty is None else bool(dirty)}
    if spark is not None:
        out |= {"spark": spark.version, "java": spark.sparkContext._jvm.System.getProperty("java.version")}
    return out

"""Append-only log of analysis runs: a run is three files that are written once and never changed.

`run-N.started.json` holds what was asked and where, `run-N.results.jsonl` the rows (with a CSV of their flat fields), and
`run-N.completed.json` or `run-N.failed.json` how it ended.  Results are bounded pages, so they are driver-side files.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from .export import NESTED, csv_text, write_export
from .provenance import canonical_hash, canonical_json, environment, evidence_hash, query_hash


class RunLog:
    def __init__(self, folder: Path | str, spark: Any = None):
        self.folder, self.spark = Path(folder), spark

    def _file(self, run_id: int, part: str) -> Path:
        return self.folder / f"run-{run_id}.{part}"

    def _once(self, run_id: int, part: str, text: str) -> None:
        with self._file(run_id, part).open("x", encoding="utf-8", newline="") as f:
            f.write(text)

    def start(self, kind: str, source: Mapping[str, Any], scope: Mapping[str, Any], params: Mapping[str, Any], profile_hash: str | None = None, allow_dirty: bool = False) -> dict[str, Any]:
        """Number a run and record its request and environment; uncommitted changes are refused unless allowed."""
        about = environment(self.spark)
        if about["git_dirty"] and not allow_dirty:
            raise ValueError("the working tree has uncommitted changes; commit them or allow a dirty run")
        self.folder.mkdir(parents=True, exist_ok=True)
        run = {
            "kind": kind, "source": dict(source), "scope": dict(scope), "params": dict(params), "profile": profile_hash, "query_hash": query_hash(kind, source, scope, params, profile_hash),
            "environment": about, "environment_hash": canonical_hash(about), "started": datetime.now(UTC),
        }
        run_id = 1 + max((int(p.name.split(".")[0][4:]) for p in self.folder.glob("run-*.started.json")), default=0)
        while True:  # a number taken by another writer meanwhile is passed over
            try:
                self._once(run_id, "started.json", canonical_json(run | {"id": run_id}) + "\n")
                return self.run(run_id)
            except FileExistsError:
                run_id += 1

    def run(self, run_id: int) -> dict[str, Any]:
        """What is known of a run, with its status: running, completed or failed."""
        try:
            out = json.loads(self._file(run_id, "started.json").read_text(encoding="utf-8"))
        except FileNotFoundError:
            raise ValueError(f"no run {run_id}") from None
        for status in ("completed", "failed"):
            if self._file(run_id, f"{status}.json").exists():
                return out | json.loads(self._file(run_id, f"{status}.json").read_text(encoding="utf-8")) | {"status": status}
        return out | {"status": "running"}

    def _open(self, run_id: int) -> None:
        if (status := self.run(run_id)["status"]) != "running":
            raise ValueError(f"run {run_id} has {status}")

    def finish(self, run_id: int, rows: list[dict[str, Any]]) -> dict[str, Any]:
        """Write the rows, then the mark of completion, so that a run without the mark has not ended."""
        self._open(run_id)
        self._once(run_id, "results.jsonl", "".join(canonical_json(r) + "\n" for r in rows))
        flat = [{k: v for k, v in r.items() if not isinstance(v, NESTED)} for r in rows]
        self._once(run_id, "results.csv", csv_text(flat, sorted({k for r in flat for k in r})))
        done = {"result_count": len(rows), "evidence_hash": evidence_hash(self.results(run_id)), "completed": datetime.now(UTC)}
        self._once(run_id, "completed.json", canonical_json(done) + "\n")
        return self.run(run_id)

    def fail(self, run_id: int, error: str) -> dict[str, Any]:
        self._open(run_id)
        self._once(run_id, "failed.json", canonical_json({"error": error}) + "\n")
        return self.run(run_id)

    def results(self, run_id: int) -> list[dict[str, Any]]:
        self.run(run_id)
        path = self._file(run_id, "results.jsonl")
        return [json.loads(x) for x in path.read_text(encoding="utf-8").split("\n") if x] if path.exists() else []

    def verify(self, run_id: int) -> dict[str, Any]:
        """Completion, hashes and number of rows, recomputed from the files."""
        run, rows = self.run(run_id), self.results(run_id)
        checks = {
            "completed": run["status"] == "completed", "environment": canonical_hash(run["environment"]) == run["environment_hash"],
            "query": query_hash(run["kind"], run["source"], run["scope"], run["params"], run["profile"]) == run["query_hash"],
            "evidence": evidence_hash(rows) == run.get("evidence_hash"), "rows": len(rows) == run.get("result_count"),
        }
        return {"ok": all(checks.values()), "id": run_id, **checks}

    def export(self, run_id: int, path: Path | str, fmt: str) -> dict[str, Any]:
        """A completed run's rows as json, jsonl or csv, with a manifest that names the run and its hashes."""
        run = self.run(run_id)
        if run["status"] != "completed":
            raise ValueError(f"run {run_id} has not completed")
        return write_export(self.results(run_id), path, fmt, run_id=run_id, query_hash=run["query_hash"], environment_hash=run["environment_hash"])

"""A store of tables that grow by committed runs only.

Layout: `runs/NNNN.json` claims a number, `claims/KEY.json` claims a key (what the run is about) for a number, `data/RUN/TABLE` holds the run's Parquet
folders, and `manifests/NNNNNNNN.json` lists all committed runs.  All small files are put if absent, in one atomic step, and never changed.  A reader takes the
latest manifest, so it sees whole runs or nothing; a writer that loses the race for the next manifest tries again on top of
the winner.  A key is committed once: asking again gives the committed run, and a claimed key without a commit is refused until it is given up.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .provenance import canonical_json
from .scratch import DROPPED, setting

#: Room for the rows of a run in its ids.
ROW_BITS = 40


class Unfinished(ValueError):
    """A run of this key was started and has not been committed."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")

    def _fs(self, at: Any) -> Any:
        return at.getFileSystem(self._conf)

    def _put(self, path: str, value: Mapping[str, Any]) -> bool:
        """Whether this call made the file; its text is whole from the first moment anyone can see it."""
        at, temporary = self._at(path), self._at(f"tmp/{uuid.uuid4().hex}")
        fs = self._fs(at)
        fs.mkdirs(at.getParent())
        stream = fs.create(temporary, True)
        stream.write(bytearray((canonical_json(value) + "\n").encode()))
        stream.close()
        if fs.getScheme() == "file":  # a link fails where the name exists; renaming would replace it
            try:
                os.link(temporary.toUri().getPath(), at.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(temporary, False)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf).rename(temporary, at, options)
            return True
        except Exception as e:  # noqa: BLE001  only an existing name is an answer
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(temporary, False)
            return False

    def _get(self, path: str) -> dict[str, Any] | None:
        at = self._at(path)
        fs = self._fs(at)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        fs = self._fs(at)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> dict[str, Any]:
        """The latest version and its committed runs by key."""
        names = self._names("manifests")
        return self._get(f"manifests/{names[-1]}") if names else {"version": 0, "runs": {}}

    def committed(self, key: str) -> dict[str, Any] | None:
        return self.manifest()["runs"].get(key)

    def claim(self, key: str) -> int:
        """A run number for this key; Unfinished where another run holds it."""
        number = 1 + max((int(n.split(".")[0]) for n in self._names("runs")), default=0)
        while not self._put(f"runs/{number:08d}.json", {"run": number, "key": key}):
            number += 1
        if not self._put(f"claims/{key}.json", {"run": number}):
            raise Unfinished(f"run {(self._get(f'claims/{key}.json') or {}).get('run')} of key {key} has not been committed")
        return number

    def give_up(self, key: str) -> None:
        """Free the key of a run that died; its data stay unread.  A committed key is left alone."""
        if self.committed(key) is None:
            at = self._at(f"claims/{key}.json")
            self._fs(at).delete(at, False)

    def write(self, run: int, name: str, df: DataFrame) -> DataFrame:
        """The table of a run, written in a folder that no other attempt uses, and read back."""
        path = f"{self.root}/data/{run:08d}/{name}-{uuid.uuid4().hex}"
        with setting(self.spark, DROPPED):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_to = path
        return out

    def commit(self, key: str, run: int, tables: Mapping[str, DataFrame], about: Mapping[str, Any]) -> dict[str, Any]:
        """Make a run visible: the next manifest, with all runs before it and this one."""
        entry = {"run": run, "about": dict(about), "tables": {n: {"path": t._written_to[len(self.root) + 1 :], "schema": t.schema.json()} for n, t in tables.items()}}
        while True:
            now = self.manifest()
            if key in now["runs"]:
                return now["runs"][key]
            if self._put(f"manifests/{now['version'] + 1:08d}.json", {"version": now["version"] + 1, "runs": now["runs"] | {key: entry}}):
                return entry

    def table(self, name: str, kind: str | None = None) -> DataFrame | None:
        """All committed rows of a table, of runs of one kind if it is named; None where no run has it."""
        from pyspark.sql import types as T

        runs = [r["tables"][name] for r in self.manifest()["runs"].values() if name in r["tables"] and kind in (None, r["about"].get("kind"))]
        if not runs:
            return None
        return self.spark.read.schema(T.StructType.fromJson(json.loads(runs[0]["schema"]))).parquet(*(f"{self.root}/{t['path']}" for t in runs))

"""Frozen normalization profiles as column expressions, with an on-demand transformation log."""

from __future__ import annotations

import copy
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import category_ranges, char_class

#: Annotation signs, and letters that read as plain alif.
ANNOTATION_RANGES = [[0x0610, 0x061A], [0x06D6, 0x06ED], [0x08D4, 0x08E1], [0x08E3, 0x08FF]]
ALIF_VARIANTS = {chr(c): "ا" for c in (0x0622, 0x0623, 0x0625, 0x0671, 0x0672, 0x0673, 0x0675)}
_MARKS = {"type": "drop_general_category_prefix", "prefix": "M"}
_SIGNS = {"type": "drop_codepoint_ranges", "ranges": ANNOTATION_RANGES}
_ALIF = {"type": "replace_codepoints", "mapping": ALIF_VARIANTS}
_OPERATIONS: dict[str, list[dict[str, Any]]] = {
    "identity_v1": [{"type": "identity"}],
    "remove_combining_marks_v1": [_MARKS],
    "normalize_alif_variants_v1": [_ALIF],
    "remove_quranic_annotations_v1": [_SIGNS],
    "base_arabic_letters_v1": [_MARKS, _SIGNS, _ALIF],
}


def profile(profile_id: str) -> dict[str, Any]:
    """A copy of a profile; ValueError for an unknown one."""
    if profile_id not in _OPERATIONS:
        raise ValueError(f"unknown normalization profile: {profile_id}")
    config = {"profile_id": profile_id, "operations": copy.deepcopy(_OPERATIONS[profile_id])}
    name, _, version = profile_id.rpartition("_")
    return {"id": profile_id, "name": name, "version": version, "configuration": config, "configuration_sha256": config_hash(config), "immutable": True}


def profiles() -> list[str]:
    return list(_OPERATIONS)


def config_hash(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dropping(ranges: tuple[tuple[int, int], ...]) -> str:
    """A pattern for runs of a large class: a range check turns most characters away before the class is tried."""
    return f"(?=[\\x{{{ranges[0][0]:X}}}-\\x{{10FFFF}}])[{char_class(ranges)}]+"


def normalize(value: Column, profile_id: str) -> Column:
    """The profile's operations in order, inside code generation: classes are pinned code point lists."""
    for op in profile(profile_id)["configuration"]["operations"]:
        if op["type"] == "drop_general_category_prefix":
            value = F.regexp_replace(value, dropping(category_ranges(op["prefix"])), "")
        elif op["type"] == "drop_codepoint_ranges":
            value = F.regexp_replace(value, f"[{char_class(tuple(map(tuple, op['ranges'])))}]+", "")
        elif op["type"] == "replace_codepoints":
            value = F.translate(value, "".join(op["mapping"]), "".join(op["mapping"].values()))
    return value


def remove_marks(value: Column) -> Column:
    """Nonspacing marks only (Mn), as staged alignment compares."""
    return F.regexp_replace(value, dropping(category_ranges("Mn")), "")


#: Columns of a log entry: place and character before the operation, what it did and why, and the place after it (null if dropped).
LOG = "array<struct<operation:int,type:string,input_index:int,input:string,source:long,action:string,output:string,reason:string,output_index:int>>"


def explain_value(value: str, profile_id: str, ids: list[int] | None = None) -> dict[str, Any]:
    """Value, log of every step of every character, and the source of each output character: one pass for each operation of the profile."""
    now, log = list(zip(value, range(len(value)) if ids is None else ids, strict=True)), []
    for number, op in enumerate(profile(profile_id)["configuration"]["operations"]):
        kind, kept = op["type"], []
        for place, (c, source) in enumerate(now):
            to, reason = c, None
            if kind == "drop_general_category_prefix" and unicodedata.category(c).startswith(op["prefix"]):
                to, reason = "", f"general_category_prefix:{op['prefix']}"
            elif kind == "drop_codepoint_ranges" and any(a <= ord(c) <= b for a, b in op["ranges"]):
                to, reason = "", "configured_codepoint_range"
            elif kind == "replace_codepoints" and c in op["mapping"]:
                to, reason = op["mapping"][c], "configured_codepoint_mapping"
            action = "keep" if reason is None else "replace" if to else "drop"
            at = None if action == "drop" else len(kept)
            log.append({"operation": number, "type": kind, "input_index": place, "input": c, "source": source, "action": action, "output": to, "reason": reason, "output_index": at})
            if at is not None:
                kept.append((to, source))
        now = kept
    return {"value": "".join(c for c, _ in now), "profile": profile_id, "log": log, "mapping": [[s] for _, s in now]}


def explained(tokens: DataFrame, profile_id: str, *keys: str, surface: str = "surface", ids: str | None = None) -> DataFrame:
    """(keys, value, log, mapping) of every token: `explain_value` as columns, batch by batch in the executors; nothing is shuffled.

    `ids` names an array column with the id of each character; without it positions stand for them.  Null surfaces have null columns.
    """
    from ..scratch import ship

    profile(profile_id)
    ship(tokens.sparkSession)
    rows = tokens.select(*keys, F.col(surface).cast("string").alias("_surface"), (F.col(ids).cast("array<long>") if ids else F.lit(None).cast("array<long>")).alias("_ids"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        entry = pa.struct([("operation", pa.int32()), ("type", pa.string()), ("input_index", pa.int32()), ("input", pa.string()), ("source", pa.int64()), ("action", pa.string()), ("output", pa.string()), ("reason", pa.string()), ("output_index", pa.int32())])
        for batch in batches:
            values, own, take = batch.column(len(keys)), batch.column(len(keys) + 1), None
            if own.null_count == len(own):  # without ids a surface has one log, however often it is met
                values, take = (e := values.dictionary_encode()).dictionary, e.indices
                own = pa.nulls(len(values))
            told = [None if v is None else explain_value(v, profile_id, i) for v, i in zip(values.to_pylist(), own.to_pylist(), strict=True)]
            columns = [pa.array([t and t["value"] for t in told], pa.string()), pa.array([t and t["log"] for t in told], pa.list_(entry)), pa.array([t and [s for (s,) in t["mapping"]] for t in told], pa.list_(pa.int64()))]
            columns = columns if take is None else [c.take(take) for c in columns]
            yield pa.record_batch([*(batch.column(k) for k in range(len(keys))), *columns], names=[*keys, "value", "log", "mapping"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}value string, log {LOG}, mapping array<long>")


#: Surfaces whose sums a worker keeps.
KEPT = 1 << 16


def log_sums(value: str, profile_id: str) -> list[tuple[int, str, int, int, int, int | None]]:
    """(operation, action, entries, sums of input_index, source and output_index) of a value's log; null where no entry has an output_index."""
    out: dict[tuple[int, str], list[Any]] = {}
    for e in explain_value(value, profile_id)["log"]:
        s = out.setdefault((e["operation"], e["action"]), [0, 0, 0, None])
        s[0] += 1
        s[1] += e["input_index"]
        s[2] += e["source"]
        s[3] = s[3] if e["output_index"] is None else (s[3] or 0) + e["output_index"]
    return [(*k, *s) for k, s in out.items()]


def explained_sums(tokens: DataFrame, profile_id: str, *keys: str, surface: str = "surface") -> DataFrame:
    """(keys, operation, action, n, places, sources, outputs): the entries of all tokens' logs, counted, with the sums of their input_index, source and output_index.

    As from the exploded logs of `explained`, whose entries are never made rows: a surface's log is summed when it is first met, and a batch gives a row for
    each of its keys, operations and actions.  A worker keeps the sums of KEPT surfaces.
    """
    import pyarrow as pa

    from ..scratch import ship

    profile(profile_id)
    ship(tokens.sparkSession)
    rows = tokens.select(*keys, F.col(surface).cast("string").alias("_surface"))
    sums, kept = ("n", "places", "sources", "outputs"), KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known: dict[str, list[tuple]] = {}
        for batch in batches:
            found = batch.column(len(keys)).dictionary_encode()
            met = []
            for v in found.dictionary.to_pylist():
                if v not in known:
                    if len(known) >= kept:
                        known.clear()
                    known[v] = log_sums(v, profile_id)
                met.append(known[v])
            sizes = np.array([len(m) for m in met], np.int64)
            firsts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(found.indices.is_valid().to_numpy(zero_copy_only=False))
            which = found.indices.drop_null().to_numpy().astype(np.int64)
            if not len(which) or not sizes.sum():
                continue
            n = sizes[which]
            row = np.repeat(at, n)
            entry = np.repeat(firsts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat = [pa.array(c, t).take(pa.array(entry)) for c, t in zip(zip(*(e for m in met for e in m), strict=True), (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)]
            names = [f"k{i}" for i in range(len(keys))]
            made = pa.table([*(batch.column(i).take(pa.array(row)) for i in range(len(keys))), *flat], names=[*names, "operation", "action", *sums])
            made = made.group_by([*names, "operation", "action"]).aggregate([(c, "sum") for c in sums])
            made = made.select([*names, "operation", "action", *(f"{c}_sum" for c in sums)]).rename_columns([*keys, "operation", "action", *sums])
            yield from made.combine_chunks().to_batches()

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    told = rows.mapInArrow(run, f"{kinds}operation int, action string, " + ", ".join(f"{c} long" for c in sums))
    return told.groupBy(*keys, "operation", "action").agg(*(F.sum(c).alias(c) for c in sums))

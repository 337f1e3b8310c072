"""Capabilities of annotation sources, scope of a request, lifecycle of sources."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..provenance import canonical_hash, canonical_json
from .ast import Boolean, Expression, Predicate, Query, RequestError, walk


class Capability(str, Enum):
    MORPHOLOGY = "morphology"
    ROOT = "root"
    LEMMA = "lemma"
    POS = "pos"
    FEATURES = "features"
    TOKEN_SEGMENTATION = "token_segmentation"
    SOURCE_LOCATOR = "source_locator"
    TOKEN_ALIGNMENT = "token_alignment"
    NORMALIZATION = "normalization"
    PARSER_STATUS = "parser_status"


_C = Capability
#: Capabilities that dimensions and count units need, besides morphology.
NEEDS: dict[str, tuple[Capability, ...]] = {
    "root": (_C.ROOT,), "lemma": (_C.LEMMA,), "pos": (_C.POS,), "feature": (_C.FEATURES,), "segment": (_C.TOKEN_SEGMENTATION,), "segment_text": (_C.TOKEN_SEGMENTATION,),
    "token": (_C.TOKEN_ALIGNMENT,), "token_text": (_C.TOKEN_ALIGNMENT,), "canonical_text": (_C.TOKEN_ALIGNMENT,), "collection": (_C.SOURCE_LOCATOR,), "unit": (_C.SOURCE_LOCATOR,),
    "alignment_method": (_C.TOKEN_ALIGNMENT,), "normalization_profile": (_C.NORMALIZATION,), "parser_status": (_C.PARSER_STATUS,),
    "MATCH_ROW": (_C.TOKEN_ALIGNMENT,), "CANONICAL_TOKEN": (_C.TOKEN_ALIGNMENT, _C.SOURCE_LOCATOR), "CANONICAL_UNIT": (_C.TOKEN_ALIGNMENT, _C.SOURCE_LOCATOR),
    "CANONICAL_COLLECTION": (_C.TOKEN_ALIGNMENT, _C.SOURCE_LOCATOR), "MORPHOLOGICAL_SEGMENT": (_C.TOKEN_SEGMENTATION,), "SOURCE_NATIVE_RECORD": (_C.SOURCE_LOCATOR,),
}


def required(query: Query, dimensions: Iterable[str] = (), unit: str | None = None) -> set[Capability]:
    names = [p.dimension for p in walk(query.where)] + list(dimensions) + ([unit] if unit else [])
    return {Capability.MORPHOLOGY} | {c for n in names for c in NEEDS.get(n, ())}


def scope_metadata(releases: dict[int, str], requested: Iterable[int], effective: Iterable[int]) -> dict[str, Any]:
    """What a result says of its scope: ids asked for, read, left out and unknown, and the adapters read by."""
    asked, read = sorted(set(requested)), sorted(set(effective))
    return {
        "requested": asked, "effective": read, "excluded": sorted(set(releases) - set(read)), "rejected": [r for r in asked if r not in releases],
        "adapters": sorted({releases[r] for r in read}),
    }


def same_adapters(releases: dict[int, str], left: Iterable[int], right: Iterable[int]) -> None:
    """Both operands of a set operation or of pairs are read by one adapter."""
    if {releases[r] for r in left} != {releases[r] for r in right}:
        raise RequestError("incompatible_source_scope", "both operands need the same adapter")


def adapter_of(metadata: dict[str, Any], formats: dict[str, str]) -> str:
    """The adapter of a release: its recorded identity, else the one that reads its format."""
    found = metadata.get("source_identity") or formats.get(str(metadata.get("format")))
    if not found:
        raise RequestError("no_registered_adapter", "neither identity nor format names an adapter")
    return str(found)


@dataclass(frozen=True)
class Adapter:
    adapter_id: str
    capabilities: frozenset[Capability]


class Registry:
    def __init__(self, adapters: Iterable[Adapter] = ()):
        self.known: dict[str, Adapter] = {}
        for a in adapters:
            self.register(a)

    def register(self, adapter: Adapter) -> None:
        if adapter.adapter_id in self.known:
            raise RequestError("annotation_framework_error", f"adapter {adapter.adapter_id} is registered")
        self.known[adapter.adapter_id] = adapter

    def get(self, adapter_id: str) -> Adapter:
        if adapter_id not in self.known:
            raise RequestError("unknown_adapter", f"unknown adapter: {adapter_id}")
        return self.known[adapter_id]

    def list(self) -> tuple[Adapter, ...]:
        return tuple(self.known[k] for k in sorted(self.known))


#: Fixed value: the adapter of the v0.4 layout.
PRODUCTION = Registry([Adapter("qac-morphology-v0.4", frozenset(Capability))])


def resolve(releases: dict[int, str], requested: Iterable[int], needed: set[Capability], registry: Registry = PRODUCTION) -> tuple[int, ...]:
    """Releases (id: adapter) that a request reads: those asked for, else all; one adapter only, which must be able to serve it."""
    asked = sorted(set(requested))
    missing = [r for r in asked if r not in releases]
    chosen = [r for r in asked if r in releases] or ([] if asked else sorted(releases))
    if missing or not chosen:
        raise RequestError("no_registered_adapter", "no aligned source release", rejected=missing)
    adapters = {releases[r] for r in chosen}
    if len(adapters) > 1:
        raise RequestError("source_selection_required", "several adapters are possible: name a source_release", adapters=sorted(adapters))
    lacking = needed - registry.get(adapters.pop()).capabilities
    if lacking:
        raise RequestError("unsupported_capability", "the source cannot serve this request", capabilities=sorted(c.value for c in lacking))
    return tuple(chosen)


def requested_releases(where: Expression, strict: bool = True) -> tuple[int, ...]:
    """Releases named by positive eq or in on a conjunctive path; under or and not they are ambiguous if `strict`."""
    found: list[set[int]] = []

    def visit(e: Expression, plain: bool) -> None:
        if isinstance(e, Predicate):
            if e.dimension == "source_release":
                if strict and not plain:
                    raise RequestError("ambiguous_source_selection", "source_release may not stand under or or not")
                if plain:
                    found.append(set(e.value if isinstance(e.value, tuple) else (e.value,)))
        elif isinstance(e, Boolean):
            for c in e.children:
                visit(c, plain and e.operator == "and")

    visit(where, True)
    ids = set.intersection(*found) if found else set()
    if strict and (len(ids) > 1 or (found and not ids)):
        raise RequestError("incompatible_source_scope", "one source release at a time")
    return tuple(sorted(ids))


class Lifecycle(str, Enum):
    DISCOVERED = "DISCOVERED"
    UNDER_REVIEW = "UNDER_REVIEW"
    AVAILABLE = "AVAILABLE"
    REGISTERED = "REGISTERED"
    INGESTED = "INGESTED"
    ACTIVE = "ACTIVE"
    DEFERRED = "DEFERRED"
    UNAVAILABLE = "UNAVAILABLE"
    UNSUPPORTED = "UNSUPPORTED"
    RETIRED = "RETIRED"


_L = Lifecycle
#: States that may follow each state.
TRANSITIONS = {
    _L.DISCOVERED: {_L.UNDER_REVIEW, _L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.UNDER_REVIEW: {_L.AVAILABLE, _L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.AVAILABLE: {_L.REGISTERED, _L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.REGISTERED: {_L.INGESTED, _L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.INGESTED: {_L.ACTIVE, _L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.ACTIVE: {_L.DEFERRED, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.DEFERRED: {_L.UNDER_REVIEW, _L.UNAVAILABLE, _L.UNSUPPORTED, _L.RETIRED},
    _L.UNAVAILABLE: {_L.UNDER_REVIEW, _L.RETIRED},
    _L.UNSUPPORTED: {_L.UNDER_REVIEW, _L.RETIRED},
    _L.RETIRED: set(),
}


def transitions(state: Lifecycle) -> frozenset[Lifecycle]:
    return frozenset(TRANSITIONS[state])


@dataclass(frozen=True)
class CatalogSource:
    source_id: str
    lifecycle: Lifecycle
    title: str = ""
    notes: str = ""

    def moved(self, to: Lifecycle) -> CatalogSource:
        if to not in transitions(self.lifecycle):
            raise RequestError("invalid_lifecycle_transition", f"{self.lifecycle.value} does not lead to {to.value}")
        return replace(self, lifecycle=to)

    def guard(self, action: str) -> None:
        """Ingestion needs a registered source, activation an ingested one."""
        need = {"ingest": Lifecycle.REGISTERED, "activate": Lifecycle.INGESTED}[action]
        if self.lifecycle is not need:
            raise RequestError("source_lifecycle_blocked", f"{action} needs {need.value}, {self.source_id} is {self.lifecycle.value}")


def catalog(sources: Iterable[CatalogSource], state: Lifecycle | None = None) -> tuple[CatalogSource, ...]:
    return tuple(sorted((s for s in sources if state is None or s.lifecycle is state), key=lambda s: s.source_id))


#: Keys of a scope and what each holds where it says nothing: kinds of units, collections in and out, single units, ranges of units in a collection,
#: ranges of the source's order, and units in an order of their own.
SCOPE: dict[str, Any] = {
    "unit_types": None, "include_collections": None, "exclude_collections": [], "exact_units": [], "unit_ranges": [], "source_order_ranges": [], "ordered_unit_ids": None,
}


def canonical_scope(config: dict[str, Any]) -> dict[str, Any]:
    """All keys, with sorted lists where order says nothing and overlapping ranges joined; RequestError for unknown keys and ranges that end before they begin."""
    unknown = sorted(set(config) - set(SCOPE))
    if unknown:
        raise RequestError("invalid_research_query", f"a scope has no {', '.join(unknown)}")
    out = SCOPE | {k: v for k, v in config.items() if v is not None}
    for k in ("unit_types", "include_collections", "exclude_collections"):
        out[k] = sorted(set(out[k])) if out[k] is not None else None
    out["exact_units"] = sorted({tuple(x) for x in out["exact_units"]})
    out["unit_ranges"] = [(c, *r) for c in sorted({x[0] for x in out["unit_ranges"]}) for r in joined((a, b) for d, a, b in out["unit_ranges"] if d == c)]
    out["source_order_ranges"] = joined(tuple(x) for x in out["source_order_ranges"])
    if out["ordered_unit_ids"] is not None:
        out["ordered_unit_ids"] = list(dict.fromkeys(out["ordered_unit_ids"]))
    return json.loads(canonical_json(out))


def joined(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges as few as possible, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if b < a:
            raise RequestError("invalid_research_query", f"range {a}..{b} ends before it begins")
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scope_hash(config: dict[str, Any]) -> str:
    """Equal for scopes that say the same."""
    return canonical_hash(canonical_scope(config))


def scoped(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The rows of a scope: all its keys must hold, of those that say something, and of exact units and ranges one.

    `rows` has collection_no and unit_no, and unit_type, source_order or unit_id where the scope names them.  All of it is one condition on plain columns, so it
    reaches the scan.  With ordered_unit_ids there is a column scope_order, the place of the row's unit in that list.
    """
    s = canonical_scope(config)
    among = lambda c, values: F.col(c).isin(list(values))
    terms = []
    for key, column in (("unit_types", "unit_type"), ("include_collections", "collection_no"), ("ordered_unit_ids", "unit_id")):
        if s[key] is not None:
            terms.append(among(column, s[key]))
    if s["exclude_collections"]:
        terms.append(~among("collection_no", s["exclude_collections"]))
    one = [(F.col("collection_no") == c) & (F.col("unit_no") == u) for c, u in s["exact_units"]]
    one += [(F.col("collection_no") == c) & F.col("unit_no").between(a, b) for c, a, b in s["unit_ranges"]]
    one += [F.col("source_order").between(a, b) for a, b in s["source_order_ranges"]]
    if one:
        terms.append(reduce(lambda a, b: a | b, one))
    out = rows.where(reduce(lambda a, b: a & b, terms)) if terms else rows
    if s["ordered_unit_ids"]:
        places = F.create_map(*(F.lit(x) for i, u in enumerate(s["ordered_unit_ids"]) for x in (u, i)))
        out = out.withColumn("scope_order", F.element_at(places, F.col("unit_id")))
    return out

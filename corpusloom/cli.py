"""Command line: ingest and what it has committed, requests, searches of a corpus, statistics, scopes, registration, runs and checks."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ingest, verification
from .export import render, verify_export
from .plans.ast import RequestError, load, request
from .functions import normalize, text as tx
from .operators import analytics, search
from .plans import scope
from .plans.projections import FILTERS, NUMBERS, MorphologyQuery
from .provenance import canonical_json, environment
from .runs import RunLog
from .store import Store

KEYS = ["collection_no", "unit_no"]
STATISTICS = {
    "summary": analytics.summary, "root": analytics.roots, "lemma": analytics.lemmas, "tag": analytics.tags, "feature": analytics.features, "collections": analytics.collections, "units": analytics.units,
    "segments": analytics.segment_distribution, "source-release": analytics.source_release_distribution, "parser-status": analytics.parser_status_distribution, "alignment": analytics.alignment_method_distribution,
}
#: Commands that answer with a page of rows.
PAGED = ("search", "count", "ngrams", "unit", "token", "tokens", "morphology", "stats", "alignment")


def paged(sub: argparse._SubParsersAction) -> None:
    """Parsers of the commands that answer with a page of rows of a corpus or an evidence table."""
    made = {name: sub.add_parser(name) for name in PAGED}
    made["search"].add_argument("kind", choices=["exact", "normalized", "substring", "phrase"])
    for c in made.values():
        c.add_argument("path")
        c.add_argument("--profile")
        c.add_argument("--limit", type=int, default=50)
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--runs", help="folder of a run log to record the page in")
        c.add_argument("--allow-dirty", action="store_true")
    made["search"].add_argument("value")
    made["search"].add_argument("--cross-unit", action="store_true", help="phrases may go over ends of units and collections")
    made["ngrams"].add_argument("n", type=int)
    made["ngrams"].add_argument("--cross-unit", action="store_true")
    made["alignment"].add_argument("--run", type=int)
    made["alignment"].add_argument("--status", choices=["aligned", "partial", "ambiguous", "unaligned", "conflict", "direct", "normalized", "unmatched"])
    made["alignment"].add_argument("--conflict", choices=["lemma", "root", "pos"])
    made["alignment"].add_argument("--locator", help="collection:unit:token")
    for name, places in (("unit", KEYS), ("token", [*KEYS, "token_no"])):
        for place in places:
            made[name].add_argument(place, type=int)
    for f in [*FILTERS, "feature"]:
        made["morphology"].add_argument(f"--{f}", type=int if f in NUMBERS else str)
    made["stats"].add_argument("name", choices=list(STATISTICS))


def page_of(spark: Any, a: argparse.Namespace) -> DataFrame:
    """The rows that a paged command asks for, in a total order."""
    if not 1 <= a.limit <= 500 or a.offset < 0:
        raise ValueError("limit must be 1..500 and offset nonnegative")
    if a.command == "morphology":
        given = {f: getattr(a, f) for f in [*FILTERS, "feature"]}
        return MorphologyQuery(**given, limit=a.limit, offset=a.offset).page(spark.read.parquet(a.path))
    if a.command == "alignment":
        place = tuple(int(x) for x in a.locator.split(":")) if a.locator else None
        rows = ingest.aligned(Store(spark, a.path), a.run, a.status, a.conflict, place)
        return rows.orderBy("alignment_id").offset(a.offset).limit(a.limit)
    if a.command == "stats":
        rows = STATISTICS[a.name](spark.read.parquet(a.path))
        order = [F.desc("n"), F.asc_nulls_last("value")] if {"n", "value"} <= set(rows.columns) else [F.asc_nulls_last(c) for c in rows.columns]
        return rows.orderBy(*order).offset(a.offset).limit(a.limit)
    from .sources.corpus import read_corpus, units

    own = units(read_corpus(spark, a.path))
    tokens = tx.tokenize(own, "text", *KEYS)
    if a.command == "count":
        return search.frequency(tokens, a.profile).orderBy(F.desc("n"), "value").offset(a.offset).limit(a.limit)
    if a.command == "ngrams":
        return search.repeated_ngrams(tokens, a.n, KEYS, a.profile, cross_unit=a.cross_unit).orderBy(F.desc("n"), "gram", "sequence_sha256").offset(a.offset).limit(a.limit)
    if a.command == "search":
        rows = {
            "exact": lambda: search.exact(tokens, a.value), "normalized": lambda: search.normalized(tokens, a.value, a.profile or ""),
            "substring": lambda: search.substring(own, tokens, a.value, KEYS), "phrase": lambda: search.phrase(tokens, a.value, KEYS, a.profile, a.cross_unit),
        }[a.kind]()
    else:
        rows = own if a.command == "unit" else search.values(tokens, a.profile)
        for place in {"unit": KEYS, "token": [*KEYS, "token_no"]}.get(a.command, []):
            rows = rows.where(F.col(place) == getattr(a, place))
    order = [*KEYS, *(c for c in ("token_no", "start") if c in rows.columns)]
    return rows.orderBy(*order).offset(a.offset).limit(a.limit)


def answer(spark: Any, a: argparse.Namespace) -> None:
    """Print a page as JSON lines; with a run log, the run is recorded first and its rows with it."""
    asked = {k: v for k, v in vars(a).items() if k not in ("runs", "allow_dirty") and v is not None}
    log = RunLog(a.runs, spark) if a.runs else None
    run = log.start(a.command, {"path": a.path}, {}, asked, allow_dirty=a.allow_dirty) if log else None
    try:
        rows = [r.asDict(True) for r in page_of(spark, a).collect()]  # at most 500 rows
    except Exception as e:
        if log:
            log.fail(run["id"], str(e))
        raise
    if log:
        log.finish(run["id"], rows)
    sys.stdout.write("".join(canonical_json(r) + "\n" for r in rows))


def normalization(a: argparse.Namespace) -> Any:
    if a.action == "list":
        return [normalize.profile(n) for n in normalize.profiles()]
    if a.action == "show":
        return normalize.profile(a.value)
    got = normalize.explain_value(a.value, a.profile or "")
    return got if a.action == "explain" else {"input": a.value, "value": got["value"], "changed": got["value"] != a.value}


def _scope(spark: Any, a: argparse.Namespace) -> dict[str, Any]:
    here = Path(a.config)
    config = load(here.read_text(encoding="utf-8") if len(a.config) < 4096 and here.is_file() else a.config, "json")
    out = {"scope": scope.canonical_scope(config), "scope_hash": scope.scope_hash(config)}
    if a.corpus:
        from .sources.corpus import read_corpus, units

        out["units"] = scope.scoped(units(read_corpus(spark, a.corpus)), config).count()
    return out


def _unicode(spark: Any, a: argparse.Namespace) -> list[dict[str, Any]]:
    from .sources.corpus import read_corpus, units

    found = tx.codepoint_inventory(units(read_corpus(spark, a.path)))
    return [r.asDict() for r in found.join(tx.unicode_dimension(spark, found), "character").orderBy("codepoint").collect()]  # at most Unicode's size


def _golden(spark: Any, a: argparse.Namespace) -> dict[str, Any]:
    from .plans.engine import Engine

    goldens, engine = verification.Goldens(a.goldens), Engine(spark.read.parquet(a.evidence))
    return goldens.verify(engine, update=a.update) if a.command == "verify" else goldens.timings(engine)


#: Commands that answer with one document.
COMMANDS = {
    "ingest-text": lambda spark, a: ingest.ingest_text(Store(spark, a.store), a.path),
    "ingest-annotations": lambda spark, a: ingest.ingest_annotations(Store(spark, a.store), a.path, a.format, a.release, a.algorithm),
    "runs": lambda spark, a: ingest.listed(Store(spark, a.store)), "give-up": lambda spark, a: Store(spark, a.store).give_up(a.key),
    "scope": _scope, "unicode": _unicode, "verify": _golden, "benchmark": _golden,
    "release-manifest": lambda spark, a: verification.manifest(ingest.releases(Store(spark, a.store))), "certificate": lambda spark, a: verification.certificate(ingest.releases(Store(spark, a.store))),
}


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: a check failed; 2: usage or a structured error."""
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("research", "explain"):
        c = sub.add_parser(name)
        c.add_argument("evidence", help="an evidence table, or with --store a store of ingested runs, whose scopes and capabilities are then checked")
        c.add_argument("request", help="file, or the request itself")
        c.add_argument("--store", action="store_true")
        c.add_argument("--format", default="json", choices=["text", "json", "yaml", "csv", "jsonl", "markdown"])
    c = sub.add_parser("corpus")
    c.add_argument("path")
    c = sub.add_parser("annotations")
    c.add_argument("path")
    c = sub.add_parser("verify-export")
    c.add_argument("path")
    sub.add_parser("environment")
    c = sub.add_parser("verify-run")
    c.add_argument("runs")
    c.add_argument("id", type=int)
    c = sub.add_parser("register")
    for name in ("path", "store", "name", "version"):
        c.add_argument(name)
    for name, words in (("ingest-text", ("store", "path")), ("ingest-annotations", ("store", "path", "format")), ("runs", ("store",)), ("give-up", ("store", "key"))):
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w, **({"choices": list(ingest.FORMATS)} if w == "format" else {}))
        if name == "ingest-annotations":
            c.add_argument("release", type=int, help="run of the text release")
            c.add_argument("--algorithm", default=ingest.STAGED, choices=[ingest.STAGED, ingest.BY_ADDRESS])
    c = sub.add_parser("scope")
    c.add_argument("config", help="file, or the scope itself")
    c.add_argument("--corpus", help="count the units of this corpus that lie in it")
    c = sub.add_parser("unicode")
    c.add_argument("path")
    c = sub.add_parser("locks")
    for name in ("verify", "benchmark"):
        c = sub.add_parser(name)
        c.add_argument("evidence")
        c.add_argument("goldens", help="folder of specs.json and snapshots")
        if name == "verify":
            c.add_argument("--update", action="store_true")
    for name in ("release-manifest", "certificate"):
        c = sub.add_parser(name)
        c.add_argument("store")
    c = sub.add_parser("normalization")
    c.add_argument("action", choices=["list", "show", "explain", "compare"])
    c.add_argument("value", nargs="?", default="")
    c.add_argument("--profile")
    paged(sub)
    a = p.parse_args(argv)
    try:
        if a.command == "verify-export":
            got = verify_export(a.path)
            print(canonical_json(got))
            return 0 if got["ok"] else 1
        if a.command == "verify-run":
            got = RunLog(a.runs).verify(a.id)
            print(canonical_json(got))
            return 0 if got["ok"] else 1
        if a.command == "normalization":
            print(canonical_json(normalization(a)))
            return 0
        if a.command == "locks":
            got = verification.locks()
            print(canonical_json(got))
            return 1 if got["failed"] else 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("corpusloom").getOrCreate()
        if a.command == "environment":
            print(canonical_json(environment(spark)))
            return 0
        if a.command == "corpus":
            from .sources.corpus import diagnostics, read_corpus

            got = diagnostics(read_corpus(spark, a.path))
            print(canonical_json(got))
            return 1 if got["failed"] else 0
        if a.command == "annotations":
            from .sources.annotations import read_v04, status_counts

            print(canonical_json({r[0]: r[1] for r in status_counts(read_v04(spark, a.path)).collect()}))
            return 0
        if a.command in PAGED:
            answer(spark, a)
            return 0
        if a.command in COMMANDS:
            got = COMMANDS[a.command](spark, a)
            print(canonical_json(got))
            return 1 if isinstance(got, dict) and got.get("failed") else 0
        if a.command == "register":
            from .sources.register import register_corpus

            got = register_corpus(spark, a.path, a.store, a.name, a.version)
            print(canonical_json(got))
            return 0 if got["status"] != "rejected" else 1
        here = Path(a.request)
        is_file = len(a.request) < 4096 and here.is_file()
        text = here.read_text(encoding="utf-8") if is_file else a.request
        asked = request(load(text, "yaml" if is_file and here.suffix in (".yaml", ".yml") else "json"))
        from .plans.engine import Engine

        store = Store(spark, a.evidence) if a.store else None
        engine = Engine(ingest.evidence(store), ingest.releases(store)) if store else Engine(spark.read.parquet(a.evidence))
        sys.stdout.write(render(engine.explain(asked) if a.command == "explain" else engine.run(asked), a.format))
        return 0
    except RequestError as e:
        print(canonical_json(e.to_dict()), file=sys.stderr)
        return 2
    except (ValueError, FileNotFoundError) as e:
        print(canonical_json({"code": "invalid_request", "message": str(e)}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

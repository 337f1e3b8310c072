"""From files to aligned evidence in one call: parse, derive, align, mark conflicts, write and commit.

A text release is a corpus file's units and tokens; an annotation run is records, analyses, segments and alignments of one annotation file against
one text release.  Both are runs of a `Store`, keyed by what they derive from: the digest of the source's lines, the release and the
algorithm.  The same call again adds nothing; a run that has not been committed is refused.

Ids are run numbers and ordinals.  Ordinals of records are line numbers, which the reader sums over byte ranges; those of tokens and
alignments are prefix sums over partitions.  No window holds a table.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.features import standard_features
from .operators import alignment
from .operators.digests import table_digest
from .operators.stream import running
from .provenance import canonical_hash
from .scratch import written
from .sources import annotations, corpus
from .sources.lines import ANY, LF_ONLY, read_lines
from .store import ROW_BITS, Store

#: Algorithms: candidates of a token's address, all kept; or the staged rules, with conflicts marked.
BY_ADDRESS, STAGED = "address-v1", "staged-v1"
FORMATS = {"v04": (LF_ONLY, annotations.parse_v04), "synthetic": (ANY, annotations.parse_synthetic)}
#: Adapter that serves the runs of each format.
ADAPTERS = {"v04": "qac-morphology-v0.4", "synthetic": "qac-morphology-v0.4"}
TEXT_VERSION, PARSE_VERSION = "text-v1", "records-v1"


def numbered(run: int, ordinal: Column) -> Column:
    return F.lit(run << ROW_BITS) + ordinal


def over_files(lines: DataFrame) -> DataFrame:
    """`lines` with source_no, the number of a line over all files of a source in the order of their paths; a row a file is broadcast."""
    rows, upto = [], 0
    for r in sorted(lines.groupBy("path").agg(F.max("line_no").alias("n")).collect()):
        rows.append((r["path"], upto))
        upto += r["n"]
    starts = F.broadcast(lines.sparkSession.createDataFrame(rows, "path string, _start long"))
    return lines.join(starts, "path").withColumn("source_no", F.col("line_no") + F.col("_start")).drop("_start")


def source_digest(lines: DataFrame) -> str:
    """Digest of a source's lines, whatever its files are called and in whatever ranges they are read."""
    return table_digest(lines.select("source_no", F.coalesce("raw", F.col("content").cast("binary")).alias("bytes"), "ending"))


def ingest_text(store: Store, path: str) -> dict[str, Any]:
    """A corpus file's lines, units and tokens as one run; {key, run, about, idempotent}.

    A file with malformed or unknown lines, empty texts or repeated addresses is refused.
    """
    parsed = over_files(written(corpus.read_corpus(store.spark, path), "parsed"))  # read once, for the digest, the diagnostics and the run
    key = canonical_hash({"source": source_digest(parsed), "version": TEXT_VERSION})
    if found := store.committed(key):
        return {"key": key, "idempotent": True} | found
    facts = corpus.diagnostics(parsed)
    if facts["failed"]:
        raise ValueError(f"the source has faults: {facts}")
    run = store.claim(key)
    lines = store.write(run, "lines", parsed)
    units = lines.where("record_type = 'unit_record'")
    units = units.select(numbered(run, F.col("source_no")).alias("unit_id"), F.lit(run).alias("release_id"), "collection_no", "unit_no", F.col("text").alias("unit_text"), F.col("source_no").alias("line_no"))
    units = running(units, ["line_no"], {"first_token": F.size(tx.surfaces(F.col("unit_text"))), "first_codepoint": F.length("unit_text"), "first_unit": F.lit(1)})
    units = store.write(run, "units", units)
    keys = ("unit_id", "release_id", "collection_no", "unit_no", "first_token")
    tokens = tx.tokenize(units, "unit_text", *keys)
    tokens = tokens.withColumn("token_id", numbered(run, F.col("first_token") + F.col("token_no"))).drop("first_token")
    tokens = store.write(run, "tokens", tokens)
    about = {"kind": "text", "counts": {"lines": lines.count(), "units": units.count(), "tokens": tokens.count()}}
    return {"key": key, "idempotent": False} | store.commit(key, run, {"lines": lines, "units": units, "tokens": tokens}, about)


def ingest_annotations(store: Store, path: str, fmt: str, release: int, algorithm: str = STAGED) -> dict[str, Any]:
    """An annotation file against a text release as one run; {key, run, about, idempotent}, about with counts by status.

    Every line is a record, with its status and error; every parsed record has an analysis and a segment; every segment has an alignment row, of the
    candidates of its address each one (BY_ADDRESS), or one with its rule (STAGED), with status `conflict` where a token's analyses differ.
    """
    if fmt not in FORMATS or algorithm not in (BY_ADDRESS, STAGED):
        raise ValueError(f"unsupported format or algorithm: {fmt}, {algorithm}")
    texts = [r for r in store.manifest()["runs"].values() if r["run"] == release and r["about"]["kind"] == "text"]
    if not texts:
        raise ValueError(f"no text release {release}")
    terminators, parse = FORMATS[fmt]
    lines = over_files(written(read_lines(store.spark, path, terminators), "lines"))
    key = canonical_hash({"source": source_digest(lines), "format": fmt, "parser": PARSE_VERSION, "release": release, "algorithm": algorithm})
    if found := store.committed(key):
        return {"key": key, "idempotent": True} | found
    run = store.claim(key)
    records = parse(lines).withColumns({"record_id": numbered(run, F.col("source_no")), "run_id": F.lit(run)})
    records = store.write(run, "records", records)
    parsed = records.where("parse_status = 'parsed'")
    analyses = store.write(run, "analyses", analysed(parsed, fmt))
    segments = store.write(run, "segments", segmented(parsed))
    tokens = store.table("tokens", "text").where(F.col("release_id") == release)
    aligned = alignments(segments, tokens, analyses, algorithm)
    aligned = running(aligned.withColumn("run_id", F.lit(run)), ["segment_id", "token_id"], {"_before": F.lit(1)})
    aligned = store.write(run, "alignments", aligned.withColumn("alignment_id", numbered(run, F.col("_before") + 1)).drop("_before"))
    alignment.check_partition(aligned, segments.count())
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    about = {
        "kind": "annotations", "format": fmt, "algorithm": algorithm, "release": release, "records": count(records, "parse_status"), "analyses": analyses.count(),
        "alignments": count(aligned, "status"),
    }
    tables = {"records": records, "analyses": analyses, "segments": segments, "alignments": aligned}
    return {"key": key, "idempotent": False} | store.commit(key, run, tables, about)


def analysed(parsed: DataFrame, fmt: str) -> DataFrame:
    """(analysis_id, record_id, run_id, lemma, root, pos, variant, transliteration, features, standard): one a parsed record."""
    none = F.lit(None).cast("string")
    own = {"pos": F.col("tag"), "variant": F.lit(1), "transliteration": none, "native": F.col("features.native")} if fmt == "v04" else {"pos": F.col("pos"), "variant": F.col("variant"), "transliteration": F.col("transliteration"), "native": F.col("features")}
    rows = parsed.select(F.col("record_id").alias("analysis_id"), "record_id", "run_id", "lemma", "root", *(c.alias(n) for n, c in own.items()))
    return rows.withColumn("standard", standard_features(F.col("native")))


def segmented(parsed: DataFrame) -> DataFrame:
    """(segment_id, analysis_id, run_id, collection_no, unit_no, token_no, segment_no, segment_index, form, locator): address parts are null where the locator is invalid."""
    place = F.col("address")  # its locator's, read once
    return parsed.select(
        F.col("record_id").alias("segment_id"), F.col("record_id").alias("analysis_id"), "run_id", *(place[c].cast("long").alias(f"{c}_no") for c in ("collection", "unit", "token", "segment")),
        F.coalesce(place["segment"], F.lit(1)).alias("segment_index"), F.col("form"), F.col("locator"),
    )


def alignments(segments: DataFrame, tokens: DataFrame, analyses: DataFrame, algorithm: str) -> DataFrame:
    """(segment_id, analysis_id, token_id, rule, status, confidence, conflict_dimensions)."""
    plain = segments.select("segment_id", "analysis_id", "collection_no", "unit_no", "token_no", "segment_no", "form")
    places = tokens.select("token_id", F.col("collection_no").cast("long").alias("collection_no"), F.col("unit_no").cast("long").alias("unit_no"), F.col("token_no").cast("long").alias("token_no"), "surface")
    if algorithm == BY_ADDRESS:
        found = alignment.align(plain, places).withColumnRenamed("method", "rule")
        return found.select("segment_id", "analysis_id", "token_id", "rule", "status", "confidence", F.array().cast("array<string>").alias("conflict_dimensions"))
    found = written(alignment.align_staged(plain, places), "found")  # once, for the conflicts and the rows that they mark
    told = found.where("token_id is not null").select("analysis_id", "token_id").hint("merge").join(analyses.select("analysis_id", "lemma", "root", "pos").hint("merge"), "analysis_id")
    return alignment.with_conflicts(found, told).select("segment_id", "analysis_id", "token_id", "rule", "status", "confidence", "conflict_dimensions")


def evidence(store: Store) -> DataFrame:
    """The store's committed annotations as an evidence table, joined for requests; release_id is the annotation run.

    Tables are merged, never built at the driver: of files with few columns read, the optimizer takes large ones for small.
    """
    from .plans.binding import COLUMNS

    large = lambda df: df.hint("merge")
    a, s, n, r = (store.table(x) for x in ("alignments", "segments", "analyses", "records"))
    tokens, units = store.table("tokens", "text"), store.table("units", "text")
    out = large(a).join(large(s.drop("analysis_id", "run_id", "collection_no", "unit_no", "token_no", "segment_no", "locator")), "segment_id")
    out = large(out).join(large(n.drop("record_id", "run_id")), "analysis_id")
    out = large(out).join(large(r.select(F.col("record_id").alias("analysis_id"), "record_id", F.col("line_no").alias("source_line"), "parse_status")), "analysis_id")
    out = large(out).join(large(tokens.drop("release_id", "delimiter_before", "start", "end")), "token_id", "left")
    out = large(out).join(large(units.select("unit_id", "unit_text")), "unit_id", "left")
    features = F.transform(F.map_entries("native"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    # a token's collection is numbered like its address
    out = out.withColumns({
        "release_id": F.col("run_id"), "run_status": F.lit("completed"), "method": F.upper("rule"), "features": features, "collection_id": F.col("collection_no"),
        "profiles": F.array().cast("array<string>"),
    })
    return out.select(*COLUMNS)




def releases(store: Store) -> dict[int, str]:
    """Committed annotation runs and the adapters that serve them, as requests need them for scope and capability checks."""
    runs = store.manifest()["runs"].values()
    return {r["run"]: ADAPTERS[r["about"]["format"]] for r in runs if r["about"]["kind"] == "annotations"}


def listed(store: Store) -> list[dict[str, Any]]:
    """What each committed run is: number, key and facts, in the order of numbers."""
    return sorted(({"run": r["run"], "key": k, **r["about"]} for k, r in store.manifest()["runs"].items()), key=lambda r: r["run"])


def aligned(store: Store, run: int | None = None, status: str | None = None, conflict: str | None = None, locator_: tuple[int, int, int] | None = None) -> DataFrame:
    """Alignment rows with their segment's address, form and locator, of one run, status, conflicting dimension or token address if named."""
    rows = store.table("alignments")
    rows = rows.join(store.table("segments").select("segment_id", "collection_no", "unit_no", "token_no", "segment_no", "form", "locator"), "segment_id")
    if run is not None:
        rows = rows.where(F.col("run_id") == run)
    if status is not None:
        rows = alignment.unresolved(rows, status)
    if conflict is not None:
        rows = alignment.conflicting(rows, conflict)
    return rows if locator_ is None else alignment.at_locator(rows, *locator_)

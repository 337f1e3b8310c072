"""Requests over an evidence table, compiled to plain DataFrame plans.

A request costs a fixed number of jobs, whatever its page holds: samples of evidence come from one windowed pass, the
four cardinalities of a set operation from one aggregate, pair counts from per-unit products without the pairs.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stream import running
from ..provenance import canonical_hash
from . import projections
from .ast import Aggregate, Boolean, Cooccurrence, Expression, Predicate, Query, RequestError, SetRequest
from .binding import GROUP, IDENTITY, base, order_columns
from .scope import PRODUCTION, Registry, required, requested_releases, resolve, same_adapters, scope_metadata

COLUMN = {"canonical_text": "unit_text", "token": "surface", "segment": "segment_index"} | {d: GROUP[d] for d in ("root", "lemma", "pos", "collection", "unit", "source_release", "alignment_method", "parser_status")}
ARRAYS = {"feature": "features", "normalization_profile": "profiles"}


def compiled(e: Expression) -> Column:
    """Membership in an array is two-valued, so `not` keeps rows without one; comparisons are three-valued as in SQL.

    contains and prefix take their text literally.
    """
    if isinstance(e, Boolean):
        parts = [compiled(c) for c in e.children]
        return ~parts[0] if e.operator == "not" else reduce(lambda a, b: a & b if e.operator == "and" else a | b, parts)
    assert isinstance(e, Predicate)
    if e.dimension in ARRAYS:
        c = F.col(ARRAYS[e.dimension])
        met = F.arrays_overlap(c, F.array(*map(F.lit, e.value))) if e.operator == "in" else F.array_contains(c, e.value)
        return F.coalesce(met, F.lit(False))
    c = F.col(COLUMN[e.dimension])
    return {"eq": lambda: c == e.value, "in": lambda: c.isin(list(e.value)), "contains": lambda: c.contains(e.value), "prefix": lambda: c.startswith(e.value)}[e.operator]()


class Engine:
    def __init__(self, evidence: DataFrame, releases: dict[int, str] | None = None, registry: Registry = PRODUCTION):
        """`releases` (id: adapter) turns scope and capability checks on."""
        self.evidence, self.releases, self.registry = evidence, releases, registry

    def scope(self, query: Query, dimensions: tuple[str, ...] = (), unit: str | None = None, strict: bool = True) -> tuple[int, ...]:
        """Releases that a request reads; it must be able to be served from them."""
        assert self.releases is not None
        return resolve(self.releases, requested_releases(query.where, strict), required(query, dimensions, unit), self.registry)

    def rows(self, query: Query, dimensions: tuple[str, ...] = (), unit: str | None = None, strict: bool = True) -> DataFrame:
        rows = base(self.evidence)
        if self.releases is not None:
            rows = rows.where(F.col("release_id").isin(list(self.scope(query, dimensions, unit, strict))))
        return rows.where(compiled(query.canonical().where))

    def operands(self, request: SetRequest | Cooccurrence) -> None:
        """Refuse operands of different adapters before anything runs."""
        if self.releases is not None:
            same_adapters(self.releases, self.scope(request.left, unit=request.identity), self.scope(request.right, unit=request.identity))

    def about(self, query: Query, dimensions: tuple[str, ...] = (), unit: str | None = None, strict: bool = True) -> dict[str, Any]:
        if self.releases is None:
            return {}
        return {"scope": scope_metadata(self.releases, requested_releases(query.where, strict), self.scope(query, dimensions, unit, strict))}

    # filter and page
    def matches(self, query: Query) -> DataFrame:
        return self.rows(query, strict=False).orderBy(*order_columns()).offset(query.offset).limit(query.limit)

    def execute(self, query: Query) -> dict[str, Any]:
        total = self.rows(query, strict=False).count()
        page = [r.asDict(True) for r in projections.research_matches(self.matches(query)).collect()]  # at most 500 rows
        return self.result("query", query, {"total": total, "returned": len(page), "truncated": query.offset + len(page) < total, "matches": page} | self.about(query, strict=False))

    # aggregate
    def groups(self, request: Aggregate) -> DataFrame:
        """All groups: dimensions and `value`, the number of distinct identities.  Null roots, lemmas and tags form no group."""
        rows = self.rows(request.query, request.group_by, request.unit)
        identity = IDENTITY[request.unit]
        rows = rows.where(F.col(identity).isNotNull())
        for d in request.group_by:
            if d in ("root", "lemma", "pos"):
                rows = rows.where(F.col(GROUP[d]).isNotNull())
        dims = [(F.explode("features") if d == "feature" else F.col(GROUP[d])).alias(d) for d in request.group_by]
        slim = rows.select(*dims, F.col(identity).alias("_id"))
        if not dims:
            return slim.agg(F.count_distinct("_id").alias("value"))
        return slim.groupBy(*request.group_by).agg(F.count_distinct("_id").alias("value"))

    def aggregate_page(self, request: Aggregate) -> DataFrame:
        order = F.desc("value") if request.order == "desc" else F.asc("value")
        return self.groups(request).orderBy(order, *(F.asc_nulls_last(d) for d in request.group_by)).offset(request.offset).limit(request.limit)

    def samples(self, request: Aggregate, page: DataFrame) -> DataFrame:
        """The first rows of each group of the page by identity: one ranked pass joined to the page, not a query a group."""
        identity = IDENTITY[request.unit]
        rows = self.rows(request.query, request.group_by, request.unit).where(F.col(identity).isNotNull())
        keys = [F.col("_f") if d == "feature" else F.col(GROUP[d]) for d in request.group_by]
        if "feature" in request.group_by:
            rows = rows.withColumn("_f", F.explode("features"))
        rows = rows.select(*(k.alias(f"_{d}") for k, d in zip(keys, request.group_by, strict=True)), identity, "alignment_id", "record_id", "analysis_id", "segment_id", "surface", "form", "method")
        if request.group_by:
            same = reduce(lambda a, b: a & b, (rows[f"_{d}"].eqNullSafe(page[d]) for d in request.group_by))
            rows = rows.join(page.select(*request.group_by), same, "left_semi")
        win = Window.partitionBy(*(f"_{d}" for d in request.group_by)).orderBy(*dict.fromkeys([identity, "alignment_id", "record_id", "analysis_id", "segment_id"]))
        ranked = rows.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= request.evidence_samples)
        return ranked.select(*(F.col(f"_{d}").alias(d) for d in request.group_by), "rank", F.col(identity).alias("stable_id"), "surface", "form", "method")

    def aggregate(self, request: Aggregate) -> dict[str, Any]:
        page_df = self.aggregate_page(request)
        page = [r.asDict() for r in page_df.collect()]
        total = self.groups(request).count() if request.group_by else 1
        out = {"total_groups": total, "groups": page, "truncated": request.offset + len(page) < total}
        if request.evidence_samples:
            out["evidence"] = [r.asDict() for r in self.samples(request, page_df).collect()]
        return self.result("aggregate", request, out | self.about(request.query, request.group_by, request.unit))

    # sets
    def tagged(self, request: SetRequest) -> DataFrame:
        """(id, l, r): one shuffle serves all four operations and their cardinalities."""
        self.operands(request)
        i = F.col(IDENTITY[request.identity])
        side = lambda q, left: self.rows(q, unit=request.identity).where(i.isNotNull()).select(i.alias("id"), F.lit(left).alias("l"), F.lit(not left).alias("r")).distinct()
        return side(request.left, True).union(side(request.right, False)).groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))

    @staticmethod
    def member(operation: str) -> Column:
        left, right = F.col("l"), F.col("r")
        return {"INTERSECTION": left & right, "UNION": left | right, "DIFFERENCE": left & ~right, "SYMMETRIC_DIFFERENCE": left != right}[operation]

    def set_ids(self, request: SetRequest) -> DataFrame:
        return self.tagged(request).where(self.member(request.operation)).select("id").orderBy("id").limit(request.limit)

    def set_counts(self, request: SetRequest) -> DataFrame:
        n = lambda c: F.count(F.when(c, 1))
        return self.tagged(request).agg(n(F.col("l")).alias("left_count"), n(F.col("r")).alias("right_count"), n(F.col("l") & F.col("r")).alias("overlap"), n(self.member(request.operation)).alias("result"))

    def set(self, request: SetRequest) -> dict[str, Any]:
        ids = [r["id"] for r in self.set_ids(request).collect()]
        out = self.set_counts(request).first().asDict() | {"ids": ids}
        if request.evidence_samples:
            out["evidence"] = self.id_evidence(request.left, request.identity, ids, request.evidence_samples)
        return self.result("set", request, out)

    def id_evidence(self, query: Query, unit: str, ids: list[int], k: int) -> list[dict[str, Any]]:
        """Evidence of ids within the request's releases; no ids, no evidence."""
        if not ids:
            return []
        rows = base(self.evidence)
        if self.releases is not None:
            rows = rows.where(F.col("release_id").isin(list(resolve(self.releases, requested_releases(query.where), required(query), self.registry))))
        identity = IDENTITY[unit]
        win = Window.partitionBy(identity).orderBy("alignment_id")
        rows = rows.where(F.col(identity).isin(ids)).withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)
        return [r.asDict(True) for r in rows.select(F.col(identity).alias("stable_id"), "rank", "surface", "form", "method").orderBy("stable_id", "rank").collect()]

    # co-occurrence
    def sides(self, request: Cooccurrence) -> tuple[DataFrame, DataFrame]:
        self.operands(request)
        own = lambda q: self.rows(q, unit="CANONICAL_TOKEN").where("unit_id is not null and token_id is not null").select("unit_id", "collection_no", "unit_no", "token_id").distinct()
        return own(request.left), own(request.right)

    def pairs(self, request: Cooccurrence) -> DataFrame:
        """Ordered pairs of distinct tokens of one unit, a token with itself included; both policies agree, as sides are distinct."""
        left, right = self.sides(request)
        right = right.select(F.col("unit_id"), F.col("token_id").alias("right_id"))
        return left.withColumnRenamed("token_id", "left_id").join(right, "unit_id").select("collection_no", "unit_no", "unit_id", "left_id", "right_id")

    def pair_page(self, request: Cooccurrence, offset: int = 0) -> DataFrame:
        """Pairs offset..offset + limit by collection, unit, left and right token; only they are made, however far the page lies.

        A unit has left tokens times right tokens pairs, so sums over the units before it number its own; the page's units follow from
        the sums, and each of their pairs from its number: left is number div rights, right the rest.
        """
        if offset < 0:
            raise RequestError("invalid_cooccurrence_scope", "offset must not be negative")
        left, right = self.sides(request)
        place = ["collection_no", "unit_no", "unit_id"]
        sizes = left.groupBy(*place).agg(F.count("*").alias("_nl")).join(right.groupBy("unit_id").agg(F.count("*").alias("_nr")), "unit_id")
        sums = running(sizes, place, {"_before": F.col("_nl") * F.col("_nr")})
        low = F.greatest(F.lit(offset) - F.col("_before"), F.lit(0))
        high = F.least(F.lit(offset + request.limit) - F.col("_before"), F.col("_nl") * F.col("_nr"))
        few = sums.where((F.col("_before") < offset + request.limit) & (F.col("_before") + F.col("_nl") * F.col("_nr") > offset))
        numbers = few.select(*place, "_nr", F.explode(F.sequence(low.cast("long"), (high - 1).cast("long"))).alias("_k"))
        numbers = numbers.select(*place, F.expr("_k div _nr").alias("_i"), F.expr("_k % _nr").alias("_j"))
        units = few.select("unit_id")
        own = Window.partitionBy("unit_id").orderBy("token_id")
        ranked = lambda side, token, rank: side.select("unit_id", "token_id").join(units, "unit_id", "left_semi").select("unit_id", F.col("token_id").alias(token), (F.row_number().over(own) - 1).cast("long").alias(rank))
        out = numbers.join(ranked(left, "left_id", "_i"), ["unit_id", "_i"]).join(ranked(right, "right_id", "_j"), ["unit_id", "_j"])
        return out.select(*place, "left_id", "right_id").orderBy(*place, "left_id", "right_id")

    def pair_counts(self, request: Cooccurrence) -> DataFrame:
        """Pairs of a unit are left tokens times right tokens; no pair is made."""
        left, right = self.sides(request)
        both = left.groupBy("unit_id", "collection_no").agg(F.count("*").alias("nl")).join(right.groupBy("unit_id").agg(F.count("*").alias("nr")), "unit_id", "full")
        met = F.col("nl").isNotNull() & F.col("nr").isNotNull()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return both.agg(total("nl").alias("left_tokens"), total("nr").alias("right_tokens"), F.count(F.when(met, 1)).alias("units"), F.count_distinct(F.when(met, F.col("collection_no"))).alias("collections"), total(F.col("nl") * F.col("nr")).alias("pairs"))

    def cooccurrence(self, request: Cooccurrence) -> dict[str, Any]:
        out = self.pair_counts(request).first().asDict()
        return self.result("cooccurrence", request, out | {"page": [r.asDict() for r in self.pair_page(request).collect()], "truncated": out["pairs"] > request.limit})

    def run(self, request: Any) -> dict[str, Any]:
        kinds = {Query: self.execute, Aggregate: self.aggregate, SetRequest: self.set, Cooccurrence: self.cooccurrence}
        if type(request) not in kinds:
            raise RequestError("invalid_research_query", "unknown request")
        return kinds[type(request)](request)

    def explain(self, request: Any, physical: bool = False) -> dict[str, Any]:
        query = request if isinstance(request, Query) else getattr(request, "query", None) or request.left
        stages = ["parse", "canonicalize", "capabilities", "scope", "filter"] + {Query: ["order", "page"], Aggregate: ["group", "count distinct", "order", "page"], SetRequest: ["distinct ids", "tag", "combine", "page"], Cooccurrence: ["distinct tokens", "join by unit", "page"]}[type(request)]
        out = {"request": request.to_dict(), "canonical": query.canonical().where.to_dict(), "capabilities": sorted(c.value for c in required(query)), "stages": stages}
        if physical:
            out["plan"] = self.rows(query, strict=False)._jdf.queryExecution().toString()
        return out

    @staticmethod
    def result(kind: str, request: Any, payload: dict[str, Any]) -> dict[str, Any]:
        """Rows with the request's canonical form, and a hash over both."""
        body = {"kind": kind, "request": request.canonical().to_dict(), **payload}
        return body | {"reproducibility_hash": canonical_hash(body)}

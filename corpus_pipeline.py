"""A corpus pipeline: toxicity, MinHash near-dedup, substring dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns the same columns; the last returns
packed pieces.  Stages are written as Parquet in between, by `run` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common, debruijn, minhash, mixing, packing, toxicity
from corpusloom.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go; a null lang has the general threshold."""
    scored = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at 0.8: of each component one document stays, the one with the smallest doc_id.

    Rows that repeat doc_id and text are one document.  Where texts differ under one doc_id, all of them take part, by a hash of
    both, and of a component the smallest hash stays.  Rows with a null doc_id and empty texts stay.
    """
    common.ship(spark)
    docs = docs.select(*COLUMNS)
    ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    own = F.col("doc_id").cast("long")
    if ids["n"] != ids["d"]:
        own = F.when(own.isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    docs = docs.withColumn("_own", own)
    found = minhash.near_duplicates(docs.select(F.col("_own").alias("doc_id"), "text"), 5, 80, tables=10)
    gone = found.where("not kept").select(F.col("doc_id").alias("_own"))
    return docs.join(gone, "_own", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 50-word windows that an earlier document also holds go; texts that lose nothing stay as they are."""
    common.ship(spark)
    docs = docs.select(*COLUMNS).withColumn("_text", F.col("text"))
    done = debruijn.remove_repeats(docs, 50, keep_text=True, carried=("_text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return done.select(
        "doc_id", F.when(changed, F.col("kept")).otherwise(F.col("_text")).alias("text"), "lang", "source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size, at the input's expected size; copies are rows."""
    return mixing.mix(docs.select(*COLUMNS), seed=7, exponent=0.5, budget=1.0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; `row` tells the copies of a document apart."""
    common.ship(spark)
    numbered = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("_row"), "text")  # docs are files, so numbers repeat
    pieces = packing.encode_pieces(numbered, tokenizer("word_bpe_49k.json"), 4096, 1, key="_row")
    return packing.pack(pieces.select("_row.doc_id", "_row.row", "piece", "start", "length", "ids_crc32"), 4096, docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Trained scores and tokenizer ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", large=True)
    return docs

"""A corpus pipeline of five stages, each over all that its predecessor kept.

quality classifier -> near-duplicate removal -> benchmark decontamination -> pseudonyms -> byte-level BPE. All stages
but the last return the columns of ``documents``; each stage's result is written as Parquet and read as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, near_dedup, pii, quality_lm
from ledgerloom.llm.common import settle, small_side, table
from ledgerloom.llm.queries import PII_KEY, bpe_digests, ranks_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity threshold."""
    return quality_lm.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of the smallest doc_id, rows without doc_id last.

    Rows are judged one by one: each has a key of its own, so that a null or repeated doc_id neither hides a copy nor
    drops another text. Rows without words form a group only if doc_id and text are equal.
    """
    rows = settle(docs.withColumns({"_row": F.monotonically_increasing_id(), "_all": F.xxhash64(*docs.columns)}))
    groups = near_dedup.near_duplicates(rows, doc_id="_row").select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    bare = lambda c: F.when(F.col("n_shingles") == 0, c)
    parts = rows.select("_row", "_all", "doc_id", F.sha2("text", 256).alias("_text")).join(groups, "_row")
    parts = settle(parts.select("_row", "_all", "doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("g"), bare(F.col("doc_id")).alias("i"), bare(F.col("_text")).alias("t")))
    first = parts.groupBy("g", "i", "t").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_all", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    lost = small_side(settle(parts.select("_row").join(first, "_row", "left_anti")))
    return rows.join(lost, "_row", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no window of a benchmark item occurs, whatever their doc_id.

    The operator's result is that of the text, so rows are dropped by doc_id, null or not, and the hash of the text:
    texts need not go through a shuffle.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = decontam.contamination(docs.select("doc_id", "text", text.alias("_text")), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = small_side(settle(hit.select(F.col("doc_id").alias("_id"), "_text").distinct()))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (text == hit["_text"]), "left_anti").select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced within its format; n_chars is counted anew."""
    out = pii.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document."""
    return bpe_digests(docs.select("doc_id", "text"), ranks_file(), keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", pseudonyms), ("byte_bpe", encode)]

#: Neither the n-gram model nor BPE can be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

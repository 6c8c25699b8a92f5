"""A search index kept as tables: postings in buckets by term, lengths of rows, and what each change added.

A change is a segment; its row in the table of segments, written last, makes it count. A writer that is cut off leaves a segment
that nobody reads, and the next one takes another number. A row's latest segment holds its postings, all others are stale.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.search import rank_hits

POSTINGS = "term string, row_key string, tf long, doc_len int, segment int, part string, bucket int"
DOCS = "row_key string, doc_len int, segment int, part string"
SEGMENTS = "segment int, part string, buckets int, rows long, tokens long"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def create(spark: SparkSession, index: str, buckets: int = 64) -> None:
    """An empty index, unless there is one."""
    for name, schema, by in (("postings", POSTINGS, ["part", "bucket"]), ("docs", DOCS, ["part"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{index}/{name}")
    spark.createDataFrame([(0, "", buckets, 0, 0)], SEGMENTS).coalesce(1).write.mode("ignore").parquet(f"{index}/segments")


def segments(spark: SparkSession, index: str) -> list:
    """The segments that count, in order; some dozens at most between two compactions."""
    return sorted(spark.read.schema(SEGMENTS).parquet(f"{index}/segments").collect(), key=lambda s: s.segment)


def _read(spark: SparkSession, index: str, name: str, schema: str) -> DataFrame:
    parts = [s.part for s in segments(spark, index) if s.part]
    return spark.read.schema(schema).parquet(f"{index}/{name}").where(F.col("part").isin(parts))


def live(spark: SparkSession, index: str) -> DataFrame:
    """row_key, doc_len, segment of every row that the index has."""
    latest = _read(spark, index, "docs", DOCS).groupBy("row_key").agg(F.max_by(F.struct("doc_len", "segment"), "segment").alias("d"))
    return latest.select("row_key", "d.doc_len", "d.segment").where("doc_len IS NOT NULL")


def change(index: str, rows: DataFrame) -> None:
    """Add the rows (row_key, text), replace those of a key that the index has, prune those whose text is null.

    Of a repeated key the greatest text counts. Rows without a key are left out. Only the changed rows are read and written.
    """
    spark = rows.sparkSession
    create(spark, index)
    before = segments(spark, index)
    number, part, buckets = before[-1].segment + 1, uuid.uuid4().hex, before[0].buckets
    old = live(spark, index)
    mark = {"segment": F.lit(number), "part": F.lit(part)}
    each = rows.where("row_key IS NOT NULL").groupBy("row_key").agg(F.max("text").alias("text")).withColumn("w", words(F.col("text")))
    each.select("row_key", F.when(F.col("text").isNotNull(), F.size("w")).alias("doc_len")).withColumns(mark).write.mode("append").partitionBy("part").parquet(f"{index}/docs")
    terms = each.select("row_key", F.size("w").alias("doc_len"), F.explode("w").alias("term")).groupBy("term", "row_key", "doc_len").agg(F.count("*").alias("tf"))
    terms.withColumns(mark).withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("part", "bucket").parquet(f"{index}/postings")
    fresh = spark.read.schema(DOCS).parquet(f"{index}/docs").where(F.col("part") == part)
    gone = old.join(fresh.select("row_key"), "row_key", "left_semi").select((-F.lit(1)).alias("n"), (-F.col("doc_len")).alias("l"))
    came = fresh.where("doc_len IS NOT NULL").select(F.lit(1).alias("n"), F.col("doc_len").alias("l"))
    delta = gone.unionByName(came).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("l"), F.lit(0)).alias("tokens"))
    delta.select(F.lit(number).alias("segment"), F.lit(part).alias("part"), F.lit(buckets).alias("buckets"), F.col("rows").cast("long"), F.col("tokens").cast("long")).coalesce(1).write.mode("append").parquet(f"{index}/segments")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def hits(spark: SparkSession, index: str, terms: list[str]) -> DataFrame:
    """term, row_key, tf, doc_len of the live rows that hold any of the terms; only the terms' buckets are read."""
    buckets = segments(spark, index)[0].buckets
    wanted = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"), buckets).alias("b")).distinct().collect()]  # as many as terms
    found = _read(spark, index, "postings", POSTINGS).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    keys = found.select("row_key").distinct()
    latest = _read(spark, index, "docs", DOCS).join(keys, "row_key", "left_semi").groupBy("row_key").agg(F.max("segment").alias("segment"))
    return found.join(latest, ["row_key", "segment"]).select("term", "row_key", "tf", "doc_len")


def search(spark: SparkSession, index: str, terms: list[str], k: int = 10) -> DataFrame:
    """row_key, score: the ``k`` best rows by BM25, as a scan over all rows would rank them."""
    if not terms:
        return spark.createDataFrame([], "row_key string, score double")
    known = segments(spark, index)
    n, tokens = sum(s.rows for s in known), sum(s.tokens for s in known)
    return rank_hits(hits(spark, index, terms).withColumnRenamed("row_key", "doc_id"), n, tokens / n if n else 0, k).withColumnRenamed("doc_id", "row_key")


def compact(spark: SparkSession, index: str, out: str) -> None:
    """The same index at ``out`` as one segment, without what is stale."""
    known = segments(spark, index)
    create(spark, out, known[0].buckets)
    part = uuid.uuid4().hex
    mark = {"segment": F.lit(1), "part": F.lit(part)}
    rows = live(spark, index)
    rows.select("row_key", "doc_len").withColumns(mark).write.mode("append").partitionBy("part").parquet(f"{out}/docs")
    kept = _read(spark, index, "postings", POSTINGS).drop("part").join(rows.select("row_key", "segment"), ["row_key", "segment"])
    kept.withColumns(mark).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("part", "bucket").parquet(f"{out}/postings")
    total = (1, part, known[0].buckets, sum(s.rows for s in known), sum(s.tokens for s in known))
    spark.createDataFrame([total], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{out}/segments")

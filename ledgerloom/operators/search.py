"""Text and vector search over rows and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bm25(docs: DataFrame, terms: list[str], k: int = 10, doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents for any of ``terms``: score to six decimals, ties to the smaller id."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    base = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")).withColumn("doc_len", F.size("w"))
    n, avg_len = base.agg(F.count("*"), F.avg("doc_len")).first()
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = base.select("doc_id", "doc_len", F.explode(F.filter("w", lambda w: F.array_contains(wanted, w))).alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))
    return rank_hits(hits, n, avg_len or 0, k, k1, b)


def rank_hits(hits: DataFrame, n: int, avg_len: float, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score: the ``k`` best of ``hits`` (term, doc_id, tf, doc_len) among n rows of avg_len words; ties to the smaller id."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / (avg_len or 1)))
    scored = hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))  # df has as many rows as terms
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def chunks(rows: DataFrame, size: int = 12) -> DataFrame:
    """By page: runs of ``size`` rows with their span and text."""
    page = Window.partitionBy("statement", "page").orderBy("seq")
    parts = rows.withColumn("chunk", F.floor((F.row_number().over(page) - 1) / size).cast("int"))
    line = F.concat_ws(" | ", F.coalesce("date", F.lit("-")), "description", F.coalesce(F.col("balance").cast("string"), F.lit("-")))
    return parts.groupBy("statement", "page", "chunk").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x.line), "\n").alias("text"))


def nearest_with_quota(vectors: DataFrame, query: list[float], quota: int = 2, k: int = 10, group: str = "label") -> DataFrame:
    """By exact L2 distance: the ``quota`` nearest of each group first, then the nearest overall up to ``k``.

    Distances are rounded to six decimals, ties go to the smaller id.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    rows = vectors.select("vec_id", group, F.round(d, 6).alias("distance"))
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("distance", "vec_id"))).where(F.col("r") <= k)
    near = near.withColumn("tier", (F.col("r") > quota).cast("int"))
    return near.orderBy("tier", "distance", "vec_id").limit(k).select("vec_id", group, "distance", "tier")


def last_turns(turns: DataFrame, keep: int = 3) -> DataFrame:
    """The last ``keep`` exchanges of each conversation, beginning with a user's turn, and how many turns were dropped."""
    own = Window.partitionBy("conv_id")
    asked = F.sum((F.col("role") == "user").cast("int")).over(own.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("exchange", asked).withColumns({"_last": F.max("exchange").over(own), "_all": F.count("*").over(own)})
    kept = rows.where((F.col("exchange") > F.col("_last") - keep) & (F.col("exchange") > 0))
    return kept.withColumn("dropped", F.col("_all") - F.count("*").over(own)).select("conv_id", "turn", "role", "exchange", "dropped")

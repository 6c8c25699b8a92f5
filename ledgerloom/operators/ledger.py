"""The ledger: ingest, coverage, evidence and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def ingest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger after a read: rows of ``new``, with the id that ``old`` had for the key, else a fresh one.

    Rows that the new read lacks are pruned. Fresh ids follow the largest old one in order of the keys, statement by
    statement; on plain Parquet the result replaces the table.
    """
    ids = old.select(*keys, F.col("row_id").alias("_id"))
    rows = new.join(ids, keys, "left")
    top = old.groupBy(keys[0]).agg(F.max("row_id").alias("_top"))
    order = Window.partitionBy(keys[0], F.col("_id").isNull()).orderBy(*keys)
    rows = rows.join(top, keys[0], "left").withColumn("row_id", F.coalesce("_id", F.coalesce("_top", F.lit(0)) + F.row_number().over(order)))
    return rows.drop("_id", "_top")


def coverage(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """By page: verdict, stored, counted and broken rows."""
    n = rows.groupBy("statement", "page").agg(F.count("*").alias("stored"), F.count_if("counted").alias("counted"), F.count_if(~F.col("ok")).alias("broken"))
    return verdicts.select("statement", "page", "verdict").join(n, ["statement", "page"], "left").select("statement", "page", "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stored", "counted", "broken")])


def unread_pages(pages: DataFrame, last: DataFrame) -> DataFrame:
    """Pages from 1 to the last (statement, last_page) that ``pages`` lacks."""
    whole = last.select("statement", F.explode(F.sequence(F.lit(1), "last_page")).alias("page"))
    return whole.join(pages.select("statement", "page").distinct(), ["statement", "page"], "left_anti")


def totals(rows: DataFrame) -> DataFrame:
    """Exact sums of counted rows by side."""
    return rows.where("counted").groupBy("statement", "side").agg(F.sum("amount").cast(MONEY).alias("total"), F.count("*").alias("n"))


def unproven(rows: DataFrame) -> DataFrame:
    return rows.where("proof = '' AND state <> 'summary'").select("statement", "seq", "page", "state")


def citation_check(cited: DataFrame, trace: DataFrame) -> DataFrame:
    """By question: rows cited, rows cited but not in the trace of the tools."""
    hit = trace.select("question", "seq").distinct().withColumn("_in", F.lit(True))
    return cited.join(hit, ["question", "seq"], "left").groupBy("question").agg(F.count("*").alias("cited"), F.count_if(F.col("_in").isNull()).alias("unsupported"))


def compare_verdicts(old: DataFrame, new: DataFrame, arbitrated: DataFrame) -> DataFrame:
    """Pages whose verdict changed, appeared or vanished; explained if an arbitration stands for the page."""
    both = old.select("statement", "page", F.col("verdict").alias("old_verdict")).join(new.select("statement", "page", F.col("verdict").alias("new_verdict")), ["statement", "page"], "full")
    both = both.where("NOT (old_verdict <=> new_verdict)").join(arbitrated.select("statement", "page").distinct().withColumn("_a", F.lit(True)), ["statement", "page"], "left")
    return both.select("statement", "page", "old_verdict", "new_verdict", F.coalesce("_a", F.lit(False)).alias("explained"))


def multiset_overlap(one: DataFrame, other: DataFrame, by: list[str], value: str) -> DataFrame:
    """By group: the sum over values of the lesser of two counts, and both sizes."""
    count = lambda t, n: t.groupBy(*by, value).agg(F.count("*").alias(n))
    both = count(one, "a").join(count(other, "b"), [*by, value], "full")
    return both.groupBy(*by).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("shared"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_one"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_other"))

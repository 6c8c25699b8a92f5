"""Acceptance, comparison and reporting operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.sources.shared import workspace

MONEY = "decimal(18,2)"


def interpolate_numbers(pages: DataFrame) -> DataFrame:
    """number and source of each page (statement, pos, read): read where a number was read, derived inside a run of equal
    offsets, extrapolated beyond the last one; pages before the first take its offset."""
    up = Window.partitionBy("statement").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("statement").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    offset = F.when(F.col("read").isNotNull(), F.col("read") - F.col("pos"))
    rows = pages.withColumns({"_up": F.last(offset, ignorenulls=True).over(up), "_down": F.first(offset, ignorenulls=True).over(down)})
    best = F.coalesce("_up", "_down")
    source = F.when(F.col("read").isNotNull(), "read").when(best.isNull(), "unknown").when(F.col("_up") == F.col("_down"), "derived").otherwise("extrapolated")
    return rows.select("statement", "pos", "read", F.coalesce("read", F.col("pos") + best).alias("number"), source.alias("source"))


def anchor_filter(pages: DataFrame, most: int) -> DataFrame:
    """Read page numbers that are shifted by more than ``most`` are taken as unread."""
    return pages.withColumn("read", F.when(F.abs(F.col("read") - F.col("pos")) <= most, F.col("read")))


def top_with_ties(rows: DataFrame, by: str, value: str) -> DataFrame:
    """All rows that have the largest ``value`` of their group."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(value)))).where("_r = 1").drop("_r")


def boundary_matches(anchors: DataFrame, reread: DataFrame) -> DataFrame:
    """Unexplained steps between pages that a movement of the same amount on the page explains."""
    return anchors.join(reread.select("statement", "page", F.col("movement").alias("_m"), "seq"), ["statement", "page"]).where("abs(crossing) = _m").select("statement", "page", "crossing", "seq")


def two_runs(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """By statement: suspects of both runs, of either, and the decision. What fails twice is a deterministic fault; a
    second run is taken if it is clean and not smaller."""
    a, b = one.select(*keys, F.col("ok").alias("_a")), two.select(*keys, F.col("ok").alias("_b"))
    rows = a.join(b, keys, "full").groupBy(keys[0]).agg(F.count_if(~F.col("_a") & ~F.col("_b")).alias("twice"), F.count_if(~F.col("_a")).alias("first_run"), F.count_if(~F.col("_b")).alias("second_run"), F.count("_a").alias("n_first"), F.count("_b").alias("n_second"))
    return rows.withColumn("decision", F.when(F.col("first_run") == 0, "first").when(F.col("twice") > 0, "deterministic").when((F.col("second_run") == 0) & (F.col("n_second") >= F.col("n_first")), "second").otherwise("undecided"))


def paired_arms(rows: DataFrame, by: str, arm: str, value: str) -> DataFrame:
    """Over pairs that both arms have: wins of each, and exact median, 95th percentile and mean difference."""
    spark, path = rows.sparkSession, workspace(rows.sparkSession)
    pairs = rows.groupBy(by).pivot(arm, ["a", "b"]).agg(F.first(value))
    pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").write.parquet(path)
    pairs = spark.read.parquet(path)
    q = {f"{c}_{name}": v for c, values in exact_quantiles(pairs, ["a", "b"], [0.5, 0.95]).items() for name, v in zip(("median", "p95"), values)}
    sums = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") < F.col("b")).alias("a_wins"), F.count_if(F.col("b") < F.col("a")).alias("b_wins"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_difference"))
    return sums.withColumns({name: F.lit(v).cast("double") for name, v in q.items()})


def census(pages: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """By class: its pages; the row ``any`` has the union, which is less than the sum where classes overlap."""
    named = pages.select("statement", "page", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in classes.items()]), lambda x: x.isNotNull())).alias("class"))
    each = named.groupBy("class").agg(F.count("*").alias("pages"))
    return each.unionByName(named.select("statement", "page").distinct().agg(F.count("*").alias("pages")).select(F.lit("any").alias("class"), "pages"))


def readiness(pages: DataFrame, flags: dict[str, tuple[Column, float]]) -> DataFrame:
    """flag, share of pages that have it, and whether it reaches its limit."""
    shares = pages.agg(*[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(n) for n, (c, _) in flags.items()])
    pairs = [F.struct(F.lit(n).alias("flag"), F.col(n).alias("share"), (F.col(n) >= least).alias("ready")) for n, (_, least) in flags.items()]
    return shares.select(F.inline(F.array(*pairs)))


def seal(pages: DataFrame) -> DataFrame:
    """A short hash of what stands on each page, by row order."""
    line = F.concat_ws("|", F.col("row_no").cast("string"), F.coalesce("date", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce(F.col("movement").cast("string"), F.lit("")), F.coalesce(F.col("balance").cast("string"), F.lit("")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x.line), "\n")
    return pages.groupBy("statement", "page").agg(F.substring(F.sha2(whole, 256), 1, 12).alias("seal"))


def score_answers(answers: DataFrame, tolerance: str = "0.05", precision: float = 0.3) -> DataFrame:
    """question, correct, cited_well, passed: amounts within the tolerance, shares of citations that are in the truth."""
    good = F.abs(F.col("amount") - F.col("truth")) <= F.lit(tolerance).cast(MONEY)
    correct = F.when(F.col("truth").isNull(), F.col("amount").isNull()).otherwise(F.coalesce(good, F.lit(False)))
    well = F.coalesce(F.size(F.array_intersect("cited", "rows")) / F.nullif(F.size("cited"), F.lit(0)) >= precision, F.lit(False))
    return answers.select("question", correct.alias("correct"), well.alias("cited_well"), (correct & (well | F.col("truth").isNull())).alias("passed"))

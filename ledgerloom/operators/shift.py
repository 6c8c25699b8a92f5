"""Descriptions of two readings: how they differ, and rows whose text slipped to a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import DIACRITICS, FOLD_FROM, FOLD_TO


def word_bag(text: Column) -> Column:
    """Words of two letters or more, of Latin or Arabic script, each with its number of occurrence: sets of these are bags."""
    t = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), DIACRITICS, ""), FOLD_FROM, FOLD_TO)
    found = F.array_sort(F.regexp_extract_all(t, F.lit(r"[a-z]{2,}|[ء-ي]{2,}"), F.lit(0)))
    numbered = lambda w: F.transform(w, lambda x, i: F.concat(x, F.lit("#"), (i + 2 - F.array_position(w, x)).cast("string")))
    return F.get(F.transform(F.array(found), numbered), F.lit(0))


def bag_relation(a: Column, b: Column) -> Column:
    """same, one_side_extra, small (two words or fewer differ) or big."""
    more, less = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return F.when((more == 0) & (less == 0), "same").when((more == 0) | (less == 0), "one_side_extra").when(more + less <= 2, "small").otherwise("big")


def bag_similarity(a: Column, b: Column) -> Column:
    """Common words in all words, with repeats; 1 for two empty bags."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def slipped(rows: DataFrame, margin: float = 0.3) -> DataFrame:
    """``rows`` with relation, own, near and run: how many rows up to this one, in a row, fit a neighbour better.

    rows: statement, page, n (place among the page's rows, without holes), text, reference (null where there is none). A
    row fits better if its text is nearer by ``margin`` to the reference of the row above or below than to its own. The
    run is broken by rows that don't or have no reference.
    """
    order = Window.partitionBy("statement", "page").orderBy("n")
    rows = rows.withColumns({"_a": word_bag(F.col("text")), "_b": F.when(F.col("reference").isNotNull(), word_bag(F.col("reference")))})
    beside = [F.coalesce(bag_similarity(F.col("_a"), F.col(c)), F.lit(0.0)) for c in ("_up", "_down")]
    rows = rows.withColumns({"_up": F.lag("_b").over(order), "_down": F.lead("_b").over(order)})
    known = F.col("_b").isNotNull()
    own = F.when(known, bag_similarity(F.col("_a"), F.col("_b")))
    near = F.greatest(*[F.when(F.col(c).isNull(), 0.0).otherwise(s) for c, s in zip(("_up", "_down"), beside)])
    rows = rows.withColumns({"relation": F.when(known, bag_relation(F.col("_a"), F.col("_b"))), "own": own, "near": near})
    fits = F.coalesce(F.col("near") > F.col("own") + margin, F.lit(False))
    rows = rows.withColumn("_fits", fits).withColumn("_kept", F.last(F.when(~F.col("_fits"), F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("n").over(Window.partitionBy("statement", "page"))
    return rows.withColumn("run", F.when(F.col("_fits"), F.col("n") - F.coalesce("_kept", first - 1)).otherwise(0).cast("int")).drop("_a", "_b", "_up", "_down", "_fits", "_kept")


def shifted_pages(rows: DataFrame, margin: float = 0.3, least: int = 2) -> DataFrame:
    """By page: rows with a reference by relation, the longest run of slipped rows and whether it counts as a shift."""
    kinds = ("same", "one_side_extra", "small", "big")
    out = slipped(rows, margin).groupBy("statement", "page").agg(F.count("reference").alias("with_reference"), *[F.count_if(F.col("relation") == k).alias(k) for k in kinds], F.max("run").alias("longest_run"))
    return out.withColumn("shifted", F.col("longest_run") >= least)

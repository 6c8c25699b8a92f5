"""Choice of page ranges for an evaluation, and what a range would cost where none is free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def choose_ranges(pages: DataFrame, length: int) -> DataFrame:
    """statement, third, size, longest, start, release: the first feasible range of ``length`` pages in each third.

    pages: statement, page, excluded, passage (beside a gap), framed (its totals were read). Pages that are neither excluded
    nor passages are dealt to three parts by number, the last takes the rest. A range starts in its part and ends within
    it; none of its pages is excluded or absent, all are framed, and so is the page before it (but for page 1). Where none
    fits, start is null and release says how many pages of the best window would have to be given up: ``length`` less the
    most pages of the part in any window between its ends; null if the part is shorter. longest: its longest run.
    """
    by_page = Window.partitionBy("statement").orderBy("page")
    span = by_page.rangeBetween(0, length - 1)
    usable = ~F.col("excluded") & F.col("framed")
    led = (F.col("page") == 1) | F.coalesce(F.lag("framed").over(by_page) & (F.col("page") - F.lag("page").over(by_page) == 1), F.lit(False))
    rows = pages.withColumns({"_led": led, "_usable": F.count_if(usable).over(span)})
    free = rows.where("NOT excluded AND NOT passage")
    number, count = F.row_number().over(by_page) - 1, F.count("*").over(Window.partitionBy("statement"))
    third = F.floor(count / 3)
    free = free.withColumn("third", F.when(number < third, 1).when(number < 2 * third, 2).otherwise(3))
    part = Window.partitionBy("statement", "third")
    order = part.orderBy("page")
    free = free.withColumns({"_lo": F.min("page").over(part), "_hi": F.max("page").over(part), "_run": F.col("page") - F.row_number().over(order), "_ahead": F.count("*").over(order.rangeBetween(0, length - 1)), "_behind": F.count("*").over(order.rangeBetween(-(length - 1), 0))})
    fits = (F.col("page") + length - 1 <= F.col("_hi")) & (F.col("_usable") == length) & F.col("_led")
    widest = F.when(F.col("page") == F.col("_hi"), F.greatest("_behind", F.when(F.col("page") + length - 1 <= F.col("_hi"), F.col("_ahead")).otherwise(0))).when(F.col("page") + length - 1 <= F.col("_hi"), F.col("_ahead"))
    longest = free.groupBy("statement", "third", "_run").count().groupBy("statement", "third").agg(F.max("count").alias("longest"))
    out = free.groupBy("statement", "third").agg(F.count("*").alias("size"), F.min(F.when(fits, F.col("page"))).alias("start"), F.max(widest).alias("_widest"), F.max(F.col("_hi") - F.col("_lo") + 1).alias("_width"))
    release = F.when(F.col("start").isNull() & (F.col("_width") >= length), length - F.col("_widest"))
    return out.join(longest, ["statement", "third"]).select("statement", "third", "size", "longest", "start", release.alias("release"))

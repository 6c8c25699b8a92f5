"""Bands of ink on pages, and text at a page's head that belongs to the row before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ink_runs(heights: Column, gap: int, least: int) -> Column:
    """array of (top, bottom): runs of inked heights with breaks of at most ``gap``; those lower than ``least`` are dust."""
    ys = F.array_sort(F.array_distinct(F.coalesce(heights, F.array().cast("array<int>"))))

    def runs(ys: Column) -> Column:
        tops = F.filter(ys, lambda y, i: (i == 0) | (y - F.get(ys, i - 1) > gap))
        bottoms = F.filter(ys, lambda y, i: (i == F.size(ys) - 1) | (F.get(ys, i + 1) - y > gap))
        both = F.zip_with(tops, bottoms, lambda a, b: F.struct(a.alias("top"), b.alias("bottom")))
        return F.filter(both, lambda r: r.bottom - r.top + 1 >= least)

    return F.get(F.transform(F.array(ys), runs), F.lit(0))


def page_bands(pages: DataFrame, gap: int = 3, least: int = 4, rise: int = 6, slack: int = 4) -> DataFrame:
    """statement, pos, kind, bands (how many), dated, orphan_top, orphan_bottom.

    pages: statement, pos and the inked heights of its columns: balance, date, text (array<int>). A run of the balance
    column anchors a band; it is dated if a run of the date column overlaps it (``slack``). kind: summary (no dates), first
    (all but the first band are dated), transactions, unknown (no bands). Text that begins more than ``rise`` above the first
    anchor is an orphan: it belongs to a row of the page before.
    """
    rows = pages.select("statement", "pos", *(ink_runs(F.col(c), gap, least).alias(c) for c in ("balance", "date", "text")))
    dated = F.transform("balance", lambda a: F.exists("date", lambda d: (d.top <= a.bottom + slack) & (d.bottom >= a.top - slack)))
    rows = rows.withColumns({"_dated": dated, "bands": F.size("balance")}).withColumn("dated", F.size(F.filter("_dated", lambda x: x)))
    first = ~F.get("_dated", F.lit(0)) & (F.col("dated") == F.col("bands") - 1)
    kind = F.when(F.col("bands") == 0, "unknown").when(F.col("dated") == 0, "summary").when(first, "first").otherwise("transactions")
    line = F.get("balance", F.lit(0)).top - rise
    above = F.filter("text", lambda t: t.top < line)
    rows = rows.withColumns({"kind": kind, "_above": F.when((F.col("bands") > 0) & (F.col("dated") > 0), above)})
    has = F.size("_above") > 0
    return rows.select("statement", "pos", "kind", "bands", "dated", F.when(has, F.get("_above", F.lit(0)).top).alias("orphan_top"), F.when(has, line - 1).alias("orphan_bottom"))


def link_orphans(bands: DataFrame, ordered: DataFrame) -> DataFrame:
    """statement, pos, owner_pos, owner_band, owner, for each page that begins with an orphan.

    ordered: statement, pos, place (the decided order), relation (to the page at the place before). owner: confirmed (the
    last band of the page before, which is adjacent by arithmetic), unconfirmed (the same, undecided or mismatched), gap
    (a sheet between is missing, so the row isn't here) or missing (no page before, or none with rows).
    """
    order = Window.partitionBy("statement").orderBy("place")
    both = bands.select("statement", "pos", "kind", "bands", "orphan_top").unionByName(ordered.select("statement", "pos", "place", "relation"), allowMissingColumns=True).where("statement IS NOT NULL AND pos IS NOT NULL")
    rows = both.groupBy("statement", "pos").agg(*[F.max(c).alias(c) for c in ("kind", "bands", "orphan_top", "place", "relation")]).where("kind IS NOT NULL AND place IS NOT NULL")  # each has one row at most; a join would move both
    rows = rows.withColumns({"_pos": F.lag("pos").over(order), "_kind": F.lag("kind").over(order), "_bands": F.lag("bands").over(order)})
    here = F.coalesce(F.col("_kind").isin("transactions", "first"), F.lit(False))
    owner = F.when(~here, "missing").when(F.col("relation") == "gap", "gap").when(F.col("relation") == "adjacent", "confirmed").otherwise("unconfirmed")
    rows = rows.where("orphan_top IS NOT NULL").withColumn("owner", owner)
    known = F.col("owner").isin("confirmed", "unconfirmed")
    return rows.select("statement", "pos", F.when(known, F.col("_pos")).alias("owner_pos"), F.when(known, F.col("_bands") - 1).alias("owner_band"), "owner")

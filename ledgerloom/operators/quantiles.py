"""Exact quantiles by narrowing histograms: no task and no buffer holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import workspace

#: Bins of a pass for each open interval.
BINS = 1024


def order_statistics(counts: DataFrame, ranks: list[int]) -> dict[int, float]:
    """rank (from 0) -> value among ``counts`` (v double, n long: how often v occurs).

    Each pass counts the values in BINS bins of every interval that still holds a wanted rank and keeps the bin with the
    rank, from its least to its greatest value, until that is one value. What comes to the driver is bounded by the ranks.
    """
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    open_, found = {r: (lo, hi, 0) for r in set(ranks)}, {}
    while open_:
        bins = []
        for a, b in sorted({(a, b) for a, b, _ in open_.values()}):
            k = F.least(F.floor((F.col("v") - a) / (b - a) * BINS), F.lit(BINS - 1)).cast("int") if b > a else F.lit(0)
            bins.append(F.when(F.col("v").between(a, b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), k.alias("k"))))
        each = counts.select("v", "n", F.explode(F.array_compact(F.array(*bins))).alias("bin"))
        rows = each.groupBy("bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by: dict[tuple, list] = {}
        for x in sorted(rows, key=lambda x: (x.bin.a, x.bin.b, x.bin.k)):
            by.setdefault((x.bin.a, x.bin.b), []).append(x)
        left = {}
        for r, (a, b, below) in open_.items():
            for x in by[a, b]:
                if r < below + x.n:
                    if x.lo == x.hi:
                        found[r] = x.lo
                    else:
                        left[r] = (x.lo, x.hi, below)
                    break
                below += x.n
        open_ = left
    return found


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float], digits: int = 6) -> dict[str, list[float | None]]:
    """column -> its values at each share, between two neighbours in proportion, rounded; null and NaN don't count.

    Equal values are counted together first, in a table of the shared folder.
    """
    out: dict[str, list[float | None]] = {}
    for c in columns:
        path = workspace(rows.sparkSession)
        rows.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count("*").alias("n")).write.parquet(path)
        counts = rows.sparkSession.read.schema("v double, n long").parquet(path)
        n = counts.agg(F.sum("n")).first()[0]
        if not n:
            out[c] = [None] * len(shares)
            continue
        places = [(n - 1) * s for s in shares]
        at = order_statistics(counts, [r for p in places for r in (math.floor(p), math.ceil(p))])
        out[c] = [round(at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]), digits) for p in places]
    return out

"""The balance chain: each row's movement and side from its balance and the one before.

A row depends on printed balances only, never on another row's derived value, so the chain is one window per statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.statements import BROUGHT, MONEY


def derive(rows: DataFrame) -> DataFrame:
    """``rows`` (statement, seq, page, description, movement, balance) with derived, side, ok, opening, boundary, scale_fixed.

    The first row of a page is compared with the last balance of any earlier row, others with the row above on the
    page; where that balance wasn't read the chain starts anew. Side '' is undecided.
    """
    page = Window.partitionBy("statement", "page").orderBy("seq")
    before = Window.partitionBy("statement").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_first": F.row_number().over(page) == 1, "_carry": F.last("balance", ignorenulls=True).over(before), "_lag": F.lag("balance").over(page)})
    rows = rows.withColumn("_prev", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).withColumn("_gap", F.abs(F.col("balance") - F.col("_prev")).cast(MONEY))
    b, m, gap = F.col("balance"), F.col("movement"), F.col("_gap")
    unread, start = b.isNull(), F.col("_prev").isNull()
    top = F.col("_first") & F.col("_prev").isNotNull()
    labelled = F.coalesce(F.col("description").contains(BROUGHT), F.lit(False))
    boundary = F.when(unread, None).when(top & (gap == 0), "carry").when(top & m.eqNullSafe(gap), "txn").when(top, "anchor")
    free = start & m.isNotNull() & ~labelled
    opening = F.when(unread, False).when(top, boundary != "txn").when(start, ~free).otherwise(False)
    derived = F.when(unread, None).when(top & (boundary == "txn"), gap).when(top, 0).when(free, m).when(start, 0).otherwise(gap).cast(MONEY)
    sign = F.when(b > F.col("_prev"), "credit").when(b < F.col("_prev"), "debit").otherwise("")
    side = F.when(unread, "").when(top, F.when(boundary == "txn", sign).otherwise("")).when(start, "").otherwise(sign)
    scaled = ~unread & ~top & ~start & (m != 0) & (m != gap) & ((m == gap * 100) | (m * 100 == gap))
    scaled = F.coalesce(scaled, F.lit(False))
    ok = F.when(unread, False).when(top | start, True).otherwise(m.isNull() | (m == gap) | scaled)
    return rows.withColumns({"boundary": boundary, "opening": opening, "derived": derived, "side": side, "ok": ok, "scale_fixed": scaled}).drop("_first", "_carry", "_lag", "_prev", "_gap")


#: The same in DuckDB, over srows: chain.
CHAIN_SQL = """
ch0 AS (SELECT *, row_number() OVER (PARTITION BY statement, page ORDER BY seq) = 1 AS first_, last_value(balance IGNORE NULLS) OVER (PARTITION BY statement ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carry_, lag(balance) OVER (PARTITION BY statement, page ORDER BY seq) AS lag_ FROM srows),
ch1 AS (SELECT *, CASE WHEN first_ THEN carry_ ELSE lag_ END AS prev FROM ch0),
ch2 AS (SELECT *, abs(balance - prev)::DECIMAL(18,2) AS gap, CASE WHEN balance IS NULL THEN 'u' WHEN first_ AND prev IS NOT NULL THEN CASE WHEN balance = prev THEN 'carry' WHEN movement = abs(balance - prev) THEN 'txn' ELSE 'anchor' END WHEN prev IS NULL THEN CASE WHEN movement IS NOT NULL AND NOT contains(description, 'Balance brought forward') THEN 'free' ELSE 'open' END ELSE 'normal' END AS kind FROM ch1),
chain AS (SELECT statement, seq, page, row_no, event_id, date, description, movement, balance, printed_side,
  CASE WHEN kind IN ('carry', 'txn', 'anchor') THEN kind END AS boundary, kind IN ('carry', 'anchor', 'open') AS opening,
  (CASE kind WHEN 'u' THEN NULL WHEN 'txn' THEN gap WHEN 'free' THEN movement WHEN 'normal' THEN gap ELSE 0 END)::DECIMAL(18,2) AS derived,
  CASE WHEN kind IN ('txn', 'normal') THEN CASE WHEN balance > prev THEN 'credit' WHEN balance < prev THEN 'debit' ELSE '' END ELSE '' END AS side,
  CASE kind WHEN 'u' THEN false WHEN 'normal' THEN movement IS NULL OR movement = gap OR (movement <> 0 AND (movement = gap * 100 OR movement * 100 = gap)) ELSE true END AS ok,
  coalesce(kind = 'normal' AND movement <> gap AND movement <> 0 AND (movement = gap * 100 OR movement * 100 = gap), false) AS scale_fixed FROM ch2)
"""

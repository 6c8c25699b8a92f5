"""The closed set of questions, answered for every statement at once.

Each answer names what it had to leave out: rows without amount, rows without date. Unknown is never zero.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import iso_date, side_of_label, transaction_kind
from ledgerloom.functions.texts import amount_argument

MONEY = "decimal(18,2)"


def movements(chained: DataFrame) -> DataFrame:
    """Rows of ``derive`` that are movements, with iso (date or null)."""
    return chained.where("NOT opening").withColumn("iso", iso_date(F.col("date")))


def select(rows: DataFrame, side: str = "all", keyword: str | None = None, kind: str | None = None, amount: str | None = None, page: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Movements that meet all conditions; an unknown side, a date that is none or a reversed range is an error.

    Undated rows meet no range. ``kind`` is part of a kind's name; an ``amount`` that can't be read filters nothing.
    """
    known = {"all": None, "debit": "debit", "credit": "credit", "out": "debit", "in": "credit"}
    if side not in known:
        raise ValueError(f"no such side: {side}")
    for day in (since, until):
        try:
            _ = day and date.fromisoformat(day)
        except ValueError:
            raise ValueError(f"no such date: {day}") from None
    if since and until and since > until:
        raise ValueError("the range ends before it begins")
    if known[side]:
        rows = rows.where(F.col("side") == known[side])
    if keyword:
        rows = rows.where(F.lower("description").contains(keyword.lower()))
    if kind:
        rows = rows.where(transaction_kind(F.col("description"), F.col("side")).contains(kind.lower()))
    if amount is not None:
        wanted = amount_argument(F.lit(amount))
        rows = rows.where(wanted.isNull() | (F.col("derived") == wanted))
    if page is not None:
        rows = rows.where(F.col("page") == page)
    if since:
        rows = rows.where(F.col("iso") >= since)
    if until:
        rows = rows.where(F.col("iso") <= until)
    return rows


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("derived"))), F.lit(0)).cast(MONEY)


def sum_movements(rows: DataFrame) -> DataFrame:
    """statement, total, n, no_amount, undated and the first three row numbers."""
    return rows.groupBy("statement").agg(_total(F.lit(True)).alias("total"), F.count("*").alias("n"), F.count_if(F.col("derived").isNull()).alias("no_amount"), F.count_if(F.col("iso").isNull()).alias("undated"), F.array_join(F.slice(F.array_sort(F.collect_set("seq")), 1, 3), ",").alias("examples"))


def balance_extremes(rows: DataFrame) -> DataFrame:
    """statement, highest and lowest balance with the first row that has it, rows without balance."""
    b = F.col("balance")
    return rows.groupBy("statement").agg(F.max(b).alias("highest"), F.max_by("seq", F.struct(b, -F.col("seq"))).alias("highest_seq"), F.min(b).alias("lowest"), F.min_by("seq", F.struct(F.when(b.isNotNull(), 0).otherwise(1), b, "seq")).alias("lowest_seq"), F.count_if(b.isNull()).alias("unread"))


def closing_balance(rows: DataFrame) -> DataFrame:
    return rows.where("balance IS NOT NULL").groupBy("statement").agg(F.max_by("balance", "seq").alias("closing"), F.max("seq").alias("seq"))


def page_summary(chained: DataFrame) -> DataFrame:
    """By statement and page: first and last balance, totals of both sides, undecided rows and their sum, rows."""
    b, moved = F.col("balance"), ~F.col("opening")
    return chained.groupBy("statement", "page").agg(
        F.min_by("balance", F.when(b.isNotNull(), F.col("seq"))).alias("first_balance"), F.max_by("balance", F.when(b.isNotNull(), F.col("seq"))).alias("last_balance"),
        _total(moved & (F.col("side") == "debit")).alias("debits"), _total(moved & (F.col("side") == "credit")).alias("credits"),
        F.count_if(moved & (F.col("side") == "")).alias("undecided"), _total(moved & (F.col("side") == "")).alias("undecided_sum"), F.count("*").alias("rows"),
    )


def page_rows(chained: DataFrame, limit: int = 40) -> DataFrame:
    """The first ``limit`` rows of each page with how many more there are."""
    page = Window.partitionBy("statement", "page")
    rows = chained.withColumns({"_n": F.row_number().over(page.orderBy("seq")), "_all": F.count("*").over(page)})
    return rows.where(F.col("_n") <= limit).select("statement", "page", "seq", "description", "derived", "side", "balance", F.greatest(F.col("_all") - limit, F.lit(0)).alias("more"))


def search_rows(rows: DataFrame, keyword: str, limit: int = 15) -> DataFrame:
    """Movements whose description holds ``keyword``: the first of each statement, and how many in all."""
    own = Window.partitionBy("statement")
    found = select(rows, keyword=keyword).withColumns({"n": F.row_number().over(own.orderBy("seq")), "found": F.count("*").over(own)})
    return found.where(F.col("n") <= limit).select("statement", "n", "seq", "description", "derived", "side", "found")


def statement_period(rows: DataFrame) -> DataFrame:
    """statement, first and last day with their rows, days (both included), weeks to two decimals, undated rows."""
    dated = F.col("iso").isNotNull()
    out = rows.groupBy("statement").agg(F.min("iso").alias("first_day"), F.min_by("seq", F.when(dated, F.struct("iso", "seq"))).alias("first_seq"), F.max("iso").alias("last_day"), F.max_by("seq", F.when(dated, F.struct("iso", -F.col("seq")))).alias("last_seq"), F.count_if(~dated).alias("undated"))
    days = (F.datediff("last_day", "first_day") + 1).cast("long")
    return out.withColumn("days", days).withColumn("weeks", F.round(F.col("days") / 7.0, 2).cast("decimal(10,2)"))


def balance_on(chained: DataFrame, day: str) -> DataFrame:
    """The last dated balance on or before ``day``; of one day the later row counts."""
    rows = chained.withColumn("iso", iso_date(F.col("date"))).where((F.col("iso") <= day) & F.col("balance").isNotNull())
    return rows.groupBy("statement").agg(F.max_by(F.struct("iso", "seq", "balance"), F.struct("iso", "seq")).alias("r")).select("statement", F.col("r.iso").alias("iso"), F.col("r.seq").alias("seq"), F.col("r.balance").alias("balance"))


def balance_each_day(chained: DataFrame, days: DataFrame) -> DataFrame:
    """As-of join: for each (statement, day) of ``days`` the last dated balance on or before it, in one ordered pass."""
    rows = chained.withColumn("iso", iso_date(F.col("date"))).where("iso IS NOT NULL AND balance IS NOT NULL").groupBy("statement", "iso").agg(F.max_by("balance", "seq").alias("balance"))
    both = rows.select("statement", "iso", F.lit(0).alias("ask"), "balance").unionByName(days.select("statement", F.col("day").alias("iso"), F.lit(1).alias("ask"), F.lit(None).cast(MONEY).alias("balance")).distinct())
    upto = Window.partitionBy("statement").orderBy("iso", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("balance", F.last("balance", ignorenulls=True).over(upto)).where("ask = 1").select("statement", F.col("iso").alias("day"), "balance")


def group_by_date(rows: DataFrame) -> DataFrame:
    """statement, day, n, debits, credits, net of dated movements."""
    out = rows.where("iso IS NOT NULL").groupBy("statement", F.col("iso").alias("day")).agg(F.count("*").alias("n"), _total(F.col("side") == "debit").alias("debits"), _total(F.col("side") == "credit").alias("credits"))
    return out.withColumn("net", (F.col("credits") - F.col("debits")).cast(MONEY))


def movement_days(rows: DataFrame) -> DataFrame:
    """statement, active days, movements, weeks, and movements and amount a week, half-even to two decimals."""
    out = rows.where("iso IS NOT NULL").groupBy("statement").agg(F.count_distinct("iso").alias("active_days"), F.count("*").alias("n"), _total(F.lit(True)).alias("total"), (F.datediff(F.max("iso"), F.min("iso")) + 1).alias("days"))
    weeks = F.bround(F.col("days").cast("decimal(18,0)") / 7, 2).cast("decimal(18,2)")
    rate = lambda c: F.bround(F.col(c).cast("decimal(18,2)") / weeks, 2).cast("decimal(18,2)")
    return out.select("statement", "active_days", "n", "total", weeks.alias("weeks"), rate("n").alias("per_week"), rate("total").alias("amount_per_week"))


def label_side(label: Column) -> Column:
    return side_of_label(label)

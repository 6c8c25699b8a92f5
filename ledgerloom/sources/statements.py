"""Statements made from the ``events`` table by a fixed rule, with planted faults.

The given tables hold no account statements, so each user's events become one: ten movements to a page, a running
balance, cumulative totals printed at each page's foot. Faults follow from remainders of ids, so SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
OPENING_CENTS = 100_000
#: Events that one task takes at most, and how few are worth one. In memory a row swells to hundreds of bytes in each sort, while a shuffle packs it to some 25.
TASK_ROWS, LEAST_ROWS = 100_000, 20_000
#: What a movement of each kind is called; these are this library's own words.
LABELS = {"purchase": "Card payment", "error": "Service fee", "view": "Standing order", "click": "Transfer received", "signup": "Deposit"}
CREDITS = ("click", "signup")
BROUGHT = "Balance brought forward"


def money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def by_user(ev: DataFrame) -> DataFrame:
    """``ev`` dealt by user to tasks of about TASK_ROWS rows at most, as all that follows stays with its user's statement.

    Adaptive execution goes by packed bytes and would give millions of rows to a task; a given number of tasks is kept.
    """
    n, cores = ev.count(), ev.sparkSession.sparkContext.defaultParallelism
    return ev.repartition(max(1, -(-n // TASK_ROWS), min(cores, -(-n // LEAST_ROWS))), "user_id")


def true_movements(ev: DataFrame) -> DataFrame:
    """statement, n, page, row_no, event_id, day, label, credit, cents, balance_cents: what really happened."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = by_user(ev.select("user_id", "ts", "event_id", "event_type", "value"))
    rows = rows.select("user_id", "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("credit", F.col("event_type").isin(*CREDITS))
    signed = F.when(F.col("credit"), F.col("cents")).otherwise(-F.col("cents"))
    rows = rows.withColumn("balance_cents", OPENING_CENTS + F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in LABELS.items()], F.lit("Other"))
    return rows.select(F.col("user_id").alias("statement"), "n", (F.floor((F.col("n") - 1) / 10) + 1).cast("int").alias("page"), ((F.col("n") - 1) % 10 + 1).alias("row_no"), "event_id", F.to_date("ts").alias("day"), label.alias("label"), "credit", "cents", "balance_cents")


def dropped(page: Column, statement: Column) -> Column:
    """Pages that the scan doesn't have."""
    return (page > 1) & ((statement + page) % 17 == 3)


def statement_rows(ev: DataFrame) -> DataFrame:
    """Rows as read from the pages, in order of seq within each statement.

    statement, seq, page, row_no, date (text), description, movement, balance, printed_side, event_id. Faults: missing
    pages, unread balances and movements, movements a hundred times too large or one too high, missing and impossible
    dates, labels in the wrong column. Some pages begin with the balance of the page before.
    """
    first = (F.col("row_no") == 1) & (F.col("page") % 4 == 2)
    rows = true_movements(ev).withColumn("_own", F.explode(F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
    e, own = F.col("event_id"), F.col("_own")
    cents = F.when(e % 29 == 3, None).when(e % 31 == 7, F.col("cents") * 100).when(e % 37 == 11, F.col("cents") + 100).otherwise(F.col("cents"))
    signed = F.when(F.col("credit"), F.col("cents")).otherwise(-F.col("cents"))
    side = F.when(F.col("credit"), "credit").otherwise("debit")
    other = F.when(F.col("credit"), "debit").otherwise("credit")
    seen = rows.where(~dropped(F.col("page"), F.col("statement"))).select(
        "statement", "page", F.when(own, F.col("row_no")).otherwise(0).alias("row_no"), F.when(own, e).alias("event_id"),
        F.when(own, F.when(e % 19 == 4, None).when(e % 41 == 6, "2024-02-30").otherwise(F.date_format("day", "yyyy-MM-dd"))).alias("date"),
        F.when(own, F.concat_ws(" ", "label", e.cast("string"))).otherwise(BROUGHT).alias("description"),
        F.when(own, money(cents)).alias("movement"),
        F.when(~own, money(F.col("balance_cents") - signed)).when(e % 23 == 5, None).otherwise(money(F.col("balance_cents"))).alias("balance"),
        F.when(own, F.when(e % 11 == 2, other).when(e % 3 == 0, None).otherwise(side)).alias("printed_side"),
    )
    order = Window.partitionBy("statement").orderBy("page", "row_no")
    return seen.withColumn("seq", F.row_number().over(order))


def statement_footers(ev: DataFrame) -> DataFrame:
    """statement, page, printed (map-free: debits, credits, balance) of each page that the scan has.

    Totals are cumulative from the first page on. Faults: unread footers (all three null) and debits ten too high.
    """
    rows = true_movements(ev).groupBy("statement", "page").agg(F.sum(F.when(~F.col("credit"), F.col("cents")).otherwise(0)).alias("d"), F.sum(F.when(F.col("credit"), F.col("cents")).otherwise(0)).alias("c"), F.max_by("balance_cents", "n").alias("b"))
    upto = Window.partitionBy("statement").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"d": F.sum("d").over(upto), "c": F.sum("c").over(upto)}).where(~dropped(F.col("page"), F.col("statement")))
    unread = (F.col("statement") * 7 + F.col("page")) % 13 == 4
    high = F.when((F.col("statement") * 3 + F.col("page")) % 19 == 8, 1000).otherwise(0)
    read = lambda c: F.when(~unread, money(c))
    return rows.select("statement", "page", read(F.col("d") + high).alias("debits"), read(F.col("c")).alias("credits"), read(F.col("b")).alias("balance"))


#: The same tables in DuckDB: tm, srows, sfoot.
BASE_SQL = """
ev0 AS (SELECT user_id AS statement, ts, event_id, event_type, round(value * 100)::BIGINT AS cents, event_type IN ('click', 'signup') AS credit FROM events),
ev1 AS (SELECT *, row_number() OVER w AS n, 100000 + sum(CASE WHEN credit THEN cents ELSE -cents END) OVER (PARTITION BY statement ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bc FROM ev0 WINDOW w AS (PARTITION BY statement ORDER BY ts, event_id)),
tm AS (SELECT statement, n, ((n - 1) // 10 + 1)::INT AS page, ((n - 1) % 10 + 1)::INT AS row_no, event_id, ts::DATE AS day, CASE event_type WHEN 'purchase' THEN 'Card payment' WHEN 'error' THEN 'Service fee' WHEN 'view' THEN 'Standing order' WHEN 'click' THEN 'Transfer received' WHEN 'signup' THEN 'Deposit' ELSE 'Other' END AS label, credit, cents, bc::BIGINT AS bc FROM ev1),
sr0 AS (SELECT statement, page, row_no, event_id, CASE WHEN event_id % 19 = 4 THEN NULL WHEN event_id % 41 = 6 THEN '2024-02-30' ELSE strftime(day, '%Y-%m-%d') END AS date, label || ' ' || event_id AS description,
   ((CASE WHEN event_id % 29 = 3 THEN NULL WHEN event_id % 31 = 7 THEN cents * 100 WHEN event_id % 37 = 11 THEN cents + 100 ELSE cents END) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS movement,
   CASE WHEN event_id % 23 = 5 THEN NULL ELSE (bc * 0.01::DECIMAL(3,2))::DECIMAL(18,2) END AS balance,
   CASE WHEN event_id % 11 = 2 THEN CASE WHEN credit THEN 'debit' ELSE 'credit' END WHEN event_id % 3 = 0 THEN NULL WHEN credit THEN 'credit' ELSE 'debit' END AS printed_side FROM tm
  UNION ALL SELECT statement, page, 0, NULL, NULL, 'Balance brought forward', NULL, ((bc - CASE WHEN credit THEN cents ELSE -cents END) * 0.01::DECIMAL(3,2))::DECIMAL(18,2), NULL FROM tm WHERE row_no = 1 AND page % 4 = 2),
srows AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY page, row_no)::INT AS seq FROM sr0 WHERE NOT (page > 1 AND (statement + page) % 17 = 3)),
sf0 AS (SELECT statement, page, sum(CASE WHEN credit THEN 0 ELSE cents END) AS d, sum(CASE WHEN credit THEN cents ELSE 0 END) AS c, arg_max(bc, n) AS b FROM tm GROUP BY ALL),
sf1 AS (SELECT statement, page, sum(d) OVER w AS d, sum(c) OVER w AS c, b, (statement * 7 + page) % 13 = 4 AS unread, CASE WHEN (statement * 3 + page) % 19 = 8 THEN 1000 ELSE 0 END AS high FROM sf0 WINDOW w AS (PARTITION BY statement ORDER BY page ROWS UNBOUNDED PRECEDING)),
sfoot AS (SELECT statement, page, CASE WHEN NOT unread THEN ((d + high)::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(18,2) END AS debits, CASE WHEN NOT unread THEN (c::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(18,2) END AS credits, CASE WHEN NOT unread THEN (b * 0.01::DECIMAL(3,2))::DECIMAL(18,2) END AS balance FROM sf1 WHERE NOT (page > 1 AND (statement + page) % 17 = 3))
"""

"""Audits: rows and pages whose evidence disagrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def label_clash(chained: DataFrame, only: dict[str, str]) -> DataFrame:
    """Rows whose description begins with words that are of one side only (``only``), while the chain gives the other."""
    side = F.coalesce(*[F.when(F.col("description").startswith(w), s) for w, s in only.items()])
    rows = chained.where("NOT opening AND side <> ''").withColumn("only_side", side)
    return rows.where("only_side <> side").select("statement", "seq", "description", "side", "only_side")


def column_clash(chained: DataFrame) -> DataFrame:
    """Rows printed in the other column than the chain gives."""
    return chained.where("printed_side IS NOT NULL AND side <> '' AND printed_side <> side").select("statement", "seq", "printed_side", "side")


def fill_dates(rows: DataFrame) -> DataFrame:
    """date_filled and date_source: the last readable date above goes to rows without one that have a movement."""
    upto = Window.partitionBy("statement").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    given = F.last("iso", ignorenulls=True).over(upto)
    source = F.when(F.col("iso").isNotNull(), "cell").when(F.col("opening"), "not_a_movement").when(given.isNotNull(), "inherited").otherwise("missing")
    rows = rows.withColumns({"_above": given, "date_source": source})
    return rows.withColumn("date_filled", F.when(F.col("date_source") == "cell", F.col("iso")).when(F.col("date_source") == "inherited", F.col("_above"))).drop("_above")


def date_inversions(rows: DataFrame) -> DataFrame:
    """By statement: pages that begin before the last page ended, rows dated before the row above on a page, dated share."""
    page = Window.partitionBy("statement", "page").orderBy("seq")
    dated = rows.where("iso IS NOT NULL").withColumn("_up", F.lag("iso").over(page))
    inner = dated.groupBy("statement", "page").agg(F.min_by("iso", "seq").alias("first"), F.max_by("iso", "seq").alias("last"), F.count_if(F.col("iso") < F.col("_up")).alias("inner"))
    pages = inner.withColumn("_before", F.lag("last").over(Window.partitionBy("statement").orderBy("page")))
    out = pages.groupBy("statement").agg(F.count_if(F.col("first") < F.col("_before")).alias("between_pages"), F.sum("inner").alias("within_pages"))
    share = rows.groupBy("statement").agg(F.round(F.avg(F.col("iso").isNotNull().cast("double")), 6).alias("dated_share"))
    return share.join(out, "statement", "left").select("statement", F.coalesce("between_pages", F.lit(0)).alias("between_pages"), F.coalesce("within_pages", F.lit(0)).alias("within_pages"), "dated_share")


def era_transitions(eras: DataFrame) -> DataFrame:
    """Pages (statement, page, era) whose era differs from the last one that wasn't none; outlier: from both neighbours."""
    order = Window.partitionBy("statement").orderBy("page")
    rows = eras.withColumns({"last_era": F.last(F.when(F.col("era") != "none", F.col("era")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_up": F.lag("era").over(order), "_down": F.lead("era").over(order)})
    return rows.select("statement", "page", "era", F.coalesce((F.col("era") != "none") & (F.col("era") != F.col("last_era")), F.lit(False)).alias("changed"), F.coalesce((F.col("_up") == F.col("_down")) & (F.col("era") != F.col("_up")), F.lit(False)).alias("outlier"))


def contract_rows(chained: DataFrame) -> DataFrame:
    """state, proof and counted of each row, and the amount it stands for.

    No balance: summary. An opening row that prints an amount is a gap anchor and stands for that amount, but isn't
    counted. Then the chain decides; a zero step is no movement.
    """
    m = F.coalesce(F.col("movement"), F.lit(0))
    state = F.when(F.col("balance").isNull(), "summary").when(F.col("opening") & (m != 0), "gap_anchor").when(F.col("opening"), "opening").when(F.col("derived") == 0, "no_movement").when(~F.col("ok"), "suspect").otherwise("ok")
    rows = chained.withColumn("state", state)
    proof = F.when(F.col("state") == "ok", F.when(F.col("side") == "", "printed").otherwise("chain")).when(F.col("state") == "gap_anchor", "gap").otherwise("")
    return rows.withColumns({"proof": proof, "counted": F.col("state").isin("ok", "suspect"), "amount": F.when(F.col("state") == "gap_anchor", F.col("movement")).otherwise(F.col("derived")).cast(MONEY)})


def islands(pages: DataFrame) -> DataFrame:
    """Longest run of consecutive pages of each statement."""
    order = Window.partitionBy("statement").orderBy("page")
    runs = pages.select("statement", "page").distinct().withColumn("k", F.col("page") - F.row_number().over(order)).groupBy("statement", "k").agg(F.count("*").alias("length"), F.min("page").alias("from_page"))
    best = Window.partitionBy("statement").orderBy(F.desc("length"), "from_page")
    return runs.withColumn("r", F.row_number().over(best)).where("r = 1").select("statement", "from_page", "length")


def close_gate(rows: DataFrame, verdicts: DataFrame, only: dict[str, str]) -> DataFrame:
    """check, failures, passed: named checks over the delivered rows (contract_rows) and page verdicts, in one pass over each.

    only: words that begin a description of one side. The identity is that the balances' difference is what came in less
    what went out.
    """
    sided = F.coalesce(*[F.when(F.col("description").startswith(w), s) for w, s in only.items()])
    of = lambda s: F.coalesce(F.sum(F.when(F.col("counted") & (F.col("side") == s), F.col("amount"))), F.lit(0))
    b = F.when(F.col("balance").isNotNull(), F.col("seq"))
    own = rows.groupBy("statement").agg(
        (F.max_by("balance", b) - F.min_by("balance", b) - of("credit") + of("debit")).alias("off"), F.count_if(F.col("state") == "suspect").alias("suspect"), F.count_if(F.col("counted") & F.col("amount").isNull()).alias("bare"),
        F.count_if(F.col("counted") & (F.col("side") != "") & (sided != F.col("side"))).alias("clash"), F.count_if((F.col("side") != "") & (F.col("printed_side") != F.col("side"))).alias("column"),
    )
    total = own.agg(F.count_if(F.col("off") != 0).alias("identity"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("suspect", "bare", "clash", "column")])
    pages = verdicts.agg(F.count_if(F.col("delta_check") == "mismatch").alias("sums"), F.count_if("jump").alias("gaps"))
    names = {"balances, money in and money out agree": "identity", "no suspect rows": "suspect", "every counted row has an amount": "bare", "no description of the other side": "clash", "no amount in the other column": "column"}
    long = lambda t, n: t.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(c).alias("failures"), (F.col(c) == 0).alias("passed")) for k, c in n.items()])))
    return long(total, names).unionByName(long(pages, {"page sums agree with printed totals": "sums", "no sheets are missing": "gaps"}))

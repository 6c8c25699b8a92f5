"""Reconciliation of pages with their printed cumulative totals, gaps between them and their order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import one_digit_apart

MONEY = "decimal(18,2)"
PARTS = ("debits", "credits", "balance")


def of_side(side: str) -> Column:
    """What a derived row moves on this side; null for opening rows and the other side."""
    return F.when(~F.col("opening") & (F.col("side") == side), F.col("derived"))


def page_totals(chained: DataFrame, **more: Column) -> DataFrame:
    """statement, page, own_debits, own_credits, own_balance (last), undecided: from the rows alone; ``more`` is aggregated with them."""
    b, moved = F.col("balance"), ~F.col("opening")
    side = lambda s: F.coalesce(F.sum(of_side(s)), F.lit(0)).cast(MONEY)
    return chained.groupBy("statement", "page").agg(side("debit").alias("own_debits"), side("credit").alias("own_credits"), F.max_by("balance", F.when(b.isNotNull(), F.col("seq"))).alias("own_balance"), F.count_if(moved & (F.col("side") == "") & F.col("derived").isNotNull()).alias("undecided"), *[c.alias(n) for n, c in more.items()])


def with_footers(totals: DataFrame, footers: DataFrame) -> DataFrame:
    """totals with the printed footer (null where not read) and the page before: its number and its footer."""
    rows = totals.join(footers, ["statement", "page"], "left")
    order = Window.partitionBy("statement").orderBy("page")
    return rows.withColumns({"before_page": F.lag("page").over(order), **{f"before_{p}": F.lag(p).over(order) for p in PARTS}})


def cumulative(rows: DataFrame) -> DataFrame:
    """cum_check: ok, mismatch or unchecked, of own sums so far against the printed totals; once broken it stays so."""
    upto = Window.partitionBy("statement").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"sum_{p}": F.sum(f"own_{p}").over(upto).cast(MONEY) for p in ("debits", "credits")})
    compared = F.col("debits").isNotNull() & F.col("credits").isNotNull()
    differs = compared & ((F.col("debits") != F.col("sum_debits")) | (F.col("credits") != F.col("sum_credits")))
    missing = F.coalesce(F.col("page") - F.col("before_page") != 1, F.col("page") != 1)
    broken = F.max(F.coalesce(differs, F.lit(False)) | missing).over(upto)
    return rows.withColumn("cum_check", F.when(~compared, "unchecked").when(broken, "mismatch").otherwise("ok"))


def step(part: str) -> Column:
    """What the printed total says that this page added."""
    return (F.col(part) - F.col(f"before_{part}")).cast(MONEY)


def delta(rows: DataFrame) -> DataFrame:
    """delta_check: own sums against the difference of two printed totals; jump: pages are missing in between."""
    jump = F.coalesce(F.col("page") - F.col("before_page") != 1, F.lit(False))
    known = step("debits").isNotNull() & step("credits").isNotNull()
    same = (step("debits") == F.col("own_debits")) & (step("credits") == F.col("own_credits"))
    return rows.withColumns({"delta_check": F.when(~known, "unchecked").when(same, "ok").otherwise("mismatch"), "jump": jump})


def verdict(rows: DataFrame) -> DataFrame:
    """Final verdict of each page: cumulative, overridden by the difference where it decides, gap after a jump.

    A mismatch that no difference confirms is unchecked. paradox: every differing part is off by exactly a hundred.
    """
    off = [(step(p), F.col(f"own_{p}")) for p in ("debits", "credits")]
    hundred = [(s == o) | (s == o * 100) | (s * 100 == o) for s, o in off]
    rows = rows.withColumn("paradox", F.coalesce((F.col("delta_check") == "mismatch") & hundred[0] & hundred[1], F.lit(False)))
    decided = F.col("delta_check") != "unchecked"
    return rows.withColumn("verdict", F.when(F.col("debits").isNull(), "absent").when(F.col("jump") & decided, "gap").when(decided, F.col("delta_check")).when(F.col("cum_check") == "mismatch", "unchecked").otherwise(F.col("cum_check")))


def gap_entries(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Missing sheets between two pages: how many, their debits and credits, and whether the balances agree.

    rows: ``delta``; edges: statement, page, first_prev (balance before the page's first row by its own movement). The
    sheets' sums are the footer's step less the page's own; the second witness is the balance crossing.
    """
    gaps = rows.where("jump").join(edges, ["statement", "page"], "left")
    net = (step("credits") - F.col("own_credits")) - (step("debits") - F.col("own_debits"))
    crossing = F.col("first_prev") - F.col("before_balance")
    return gaps.select("statement", "before_page", "page", (F.col("page") - F.col("before_page") - 1).alias("sheets"), (step("debits") - F.col("own_debits")).cast(MONEY).alias("gap_debits"), (step("credits") - F.col("own_credits")).cast(MONEY).alias("gap_credits"), F.when(net.isNull() | crossing.isNull(), "unproven").when(F.abs(net - crossing) <= F.lit("0.01").cast(MONEY), "proven").otherwise("disagreed").alias("witness"))


def spans(rows: DataFrame) -> DataFrame:
    """Between pages with a read footer: pages, own sums and the footers' difference; held if both agree.

    Pages whose own footer wasn't read are proven by a span that holds (gained).
    """
    framed = F.col("debits").isNotNull()
    up = Window.partitionBy("statement").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("span", F.coalesce(F.sum(framed.cast("int")).over(up), F.lit(0)))
    out = rows.groupBy("statement", "span").agg(F.min("page").alias("from_page"), F.max("page").alias("to_page"), F.count("*").alias("pages"), F.sum("own_debits").cast(MONEY).alias("own_debits"), F.sum("own_credits").cast(MONEY).alias("own_credits"), F.max("debits").alias("debits"), F.max("credits").alias("credits"), F.count_if(~framed).alias("frameless"), F.max(F.col("jump").cast("int")).alias("jumps"))
    order = Window.partitionBy("statement").orderBy("span")
    d, c = (F.col(p) - F.lag(p).over(order) for p in ("debits", "credits"))
    held = F.coalesce((d == F.col("own_debits")) & (c == F.col("own_credits")) & (F.col("jumps") == 0), F.lit(False))
    return out.withColumn("held", held).withColumn("gained", F.when(F.col("held"), F.col("frameless")).otherwise(F.lit(0))).select("statement", "span", "from_page", "to_page", "pages", "held", "gained")


def relation(order: WindowSpec, number: Column) -> Column:
    """adjacent, gap, mismatch or undecided, towards the page before in ``order``; null for the first page.

    adjacent: the printed totals rise by the page's own sums. Else a jump of the printed ``number`` is a gap; totals that
    disagree without one are a mismatch: a misread digit, or a missing sheet without a number.
    """
    up = {p: F.lag(p).over(order) for p in ("debits", "credits")}
    risen = {p: (F.col(p) - up[p]).cast(MONEY) for p in up}
    known = [risen[p].isNotNull() & F.col(f"own_{p}").isNotNull() for p in up]
    same = [risen[p] == F.col(f"own_{p}") for p in up]
    jump = F.coalesce(number > F.lag(number).over(order) + 1, F.lit(False))
    first = F.row_number().over(order) == 1
    return F.when(first, None).when(known[0] & known[1] & same[0] & same[1], "adjacent").when(jump, "gap").when(known[0] & known[1], "mismatch").otherwise("undecided")


def adjacency(rows: DataFrame, number: str = "page") -> DataFrame:
    """Each pair of neighbouring pages with their relation, by printed totals, own sums and printed numbers."""
    order = Window.partitionBy("statement").orderBy("page")
    out = rows.withColumn("relation", relation(order, F.col(number)))
    return out.where("before_page IS NOT NULL").select("statement", "before_page", "page", "relation")


def page_numbers(pages: DataFrame) -> DataFrame:
    """Missing page numbers of each statement as runs: from, to, how many."""
    order = Window.partitionBy("statement").orderBy("page")
    rows = pages.select("statement", "page").distinct().withColumn("last", F.coalesce(F.lag("page").over(order), F.lit(0)))
    return rows.where("page - last > 1").select("statement", (F.col("last") + 1).alias("from_page"), (F.col("page") - 1).alias("to_page"), (F.col("page") - F.col("last") - 1).alias("missing"))


def order_conflicts(footers: DataFrame, position: str = "page") -> DataFrame:
    """Pages out of order by their printed totals: sorted by both totals, a page conflicts if one total falls."""
    read = footers.where("debits IS NOT NULL AND credits IS NOT NULL")
    order = Window.partitionBy("statement").orderBy("debits", "credits", position)
    rows = read.withColumns({"rank": F.row_number().over(order), "_c": F.lag("credits").over(order), "_d": F.lag("debits").over(order), "_p": F.lag(position).over(order)})
    return rows.select("statement", position, "rank", F.coalesce(F.col("credits") < F.col("_c"), F.lit(False)).alias("conflict"), F.coalesce((F.col("credits") == F.col("_c")) & (F.col("debits") == F.col("_d")), F.lit(False)).alias("duplicate"), F.coalesce(F.col(position) < F.col("_p"), F.lit(False)).alias("moved_back"))


def _longest_run(ranks: list[int]) -> list[bool]:
    """Which places belong to one longest increasing run."""
    best: list[tuple[int, int]] = []  # by place: length of the longest run that ends here, place before it
    ends: dict[int, int] = {}  # by length: the place of the smallest rank that ends such a run
    for place, rank in enumerate(ranks):
        low, high = 0, len(ends)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if ranks[ends[middle]] < rank else (low, middle - 1)
        best.append((low + 1, ends.get(low, -1)))
        ends[low + 1] = place
    keep, place = set(), ends.get(len(ends), -1)
    while place >= 0:
        keep.add(place)
        place = best[place][1]
    return [i in keep for i in range(len(ranks))]


def fewest_moved(ranked: DataFrame, position: str = "page") -> DataFrame:
    """statement, position, moved: pages off one longest run in which file order and printed order agree.

    A patience sort per statement; a statement has some hundreds of pages.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p", kind="stable")
        return pd.DataFrame({"statement": pdf["statement"], position: pdf["_p"], "moved": [not k for k in _longest_run(pdf["rank"].tolist())]})

    return ranked.select("statement", F.col(position).alias("_p"), "rank").groupBy("statement").applyInPandas(run, f"statement long, {position} int, moved boolean")


def repair_balances(chained: DataFrame, rounds: int = 3) -> DataFrame:
    """statement, seq, balance, repaired: balances that are one digit off.

    A row's balance becomes the one above less its movement, else that plus its movement, if it differs from what was read
    by one character, the next balance differs from it, and the next row closes with it by its printed movement. Each of
    ``rounds`` passes looks at the balances of the one before. Within a pass a row behind a repaired one waits for the next
    pass: of consecutive rows that could be repaired every second one is, beginning with the first, so that all of it is
    windows over one order of each statement.
    """
    order = Window.partitionBy("statement").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = chained.select("statement", "seq", "movement", "balance", F.lit(False).alias("repaired"))
    for _ in range(rounds):
        rows = rows.withColumns({"_above": F.lag("balance").over(order), "_below": F.lead("balance").over(order), "_next": F.lead("movement").over(order), "_n": F.row_number().over(order)})
        fits = lambda x: one_digit_apart(x.cast("string"), F.col("balance").cast("string")) & (F.abs(F.col("_below") - x) == F.col("_next")) & (F.col("_below") != x)
        led = [(F.col("_above") + sign * F.col("movement")).cast(MONEY) for sign in (-1, 1)]
        rows = rows.withColumn("_fresh", F.coalesce(*[F.when(fits(x), x) for x in led]))
        place = F.col("_n") - F.coalesce(F.last(F.when(F.col("_fresh").isNull(), F.col("_n")), ignorenulls=True).over(upto), F.lit(0))
        rows = rows.withColumn("_take", F.col("_fresh").isNotNull() & (place % 2 == 1))
        rows = rows.select("statement", "seq", "movement", F.when(F.col("_take"), F.col("_fresh")).otherwise(F.col("balance")).alias("balance"), (F.col("repaired") | F.col("_take")).alias("repaired"))
    return rows.select("statement", "seq", "balance", "repaired")

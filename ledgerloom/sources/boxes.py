"""Rows of a statement from the words of its pages and their places.

words: statement, page, top, x (left edge), text. All questions of order are windows over pages or statements; only the
repair of visual order runs in Python, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.visual import logical_order

MONEY = "decimal(18,2)"
AMOUNT, DAY = r"^-?[0-9,]+\.[0-9]{2}$", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"


@dataclass(frozen=True)
class Layout:
    """Where columns stand and which lines are no descriptions; the words are the caller's own."""

    amounts_from: float = 300.0
    descriptions_from: float = 100.0
    tolerance: float = 3.0
    longest: int = 600
    skipped: tuple[str, ...] = ("Ref.", "Date", "Statement")
    heading_prefixes: tuple[str, ...] = ()
    headings: frozenset[str] = field(default_factory=frozenset)
    notes: tuple[str, ...] = ("Time:", "Notes:")


def lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``words`` with line (from 1 on each page): a word joins a line up to ``tolerance`` below the line's first word.

    The first word rules, not the last one, so a drifting line is cut where neighbours in height would be one cluster.
    The fold that finds each page's first words runs over its distinct heights; a page's words are held together for it,
    so they are made and moved once.
    """
    page = ["statement", "page"]
    rest = [c for c in words.columns if c not in page]
    whole = words.groupBy(page).agg(F.array_sort(F.collect_set("top")).alias("_tops"), F.collect_list(F.struct(*rest)).alias("_words"))
    first = F.aggregate(F.slice("_tops", F.lit(2), F.size("_tops")), F.slice("_tops", 1, 1), lambda acc, x: F.when(x - F.element_at(acc, -1) > tolerance, F.concat(acc, F.array(x))).otherwise(acc))
    each = whole.select(*page, first.alias("_firsts"), "_words").select(*page, "_firsts", F.explode("_words").alias("_word"))
    return each.select(*page, "_firsts", "_word.*").withColumn("line", F.size(F.filter("_firsts", lambda a: a <= F.col("top")))).select(*words.columns, "line")


def _begins(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


def _stripped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"^[\s{also}]+|[\s{also}]+$", "")


def printed_lines(words: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """One row for each line: statement, page, line, kind, text, day, cells (the amounts), said (words of the description).

    kind: row (three amounts or more), skipped, note or text. A line of notes above all rows of its statement is text.
    """
    each = lines(words, layout.tolerance).groupBy("statement", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "top", "text"))).alias("w"))
    right, left = (lambda w: w.x > layout.amounts_from), (lambda w: w.x < layout.descriptions_from)
    day = F.filter("w", lambda w: left(w) & w.text.rlike(DAY))
    said = F.filter("w", lambda w: ~right(w) & ~(left(w) & w.text.rlike(DAY)))
    each = each.select("statement", "page", "line", F.transform(F.filter("w", lambda w: right(w) & w.text.rlike(AMOUNT)), lambda w: w.text).alias("cells"), F.get(F.transform(day, lambda w: w.text), F.lit(0)).alias("day"), F.transform(said, lambda w: w.text).alias("said"), _stripped(F.array_join(F.transform("w", lambda w: w.text), " ")).alias("text"))
    each = each.withColumn("logical", logical_order("text"))
    text = F.col("text")
    heading = _stripped("logical", "·").isin(*layout.headings) if layout.headings else F.lit(False)
    note = _begins(text, layout.notes)
    none = (text == "") | _begins(text, layout.skipped) | heading | (_begins(text, layout.heading_prefixes) & ~note)
    is_row = F.size("cells") >= 3
    order = Window.partitionBy("statement").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.when(is_row, 1).otherwise(0)).over(order), F.lit(0))
    return each.withColumns({"above": above, "kind": F.when(is_row, "row").when(none, "skipped").when(note & (above > 0), "note").otherwise("text")})


def rows_of_words(words: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """statement, page, row_no (within the statement), date, movement, balance, description, raw_movement, raw_balance.

    A row's line holds debit, credit and balance; its movement is the credit if that isn't zero, else the debit. Lines of
    text on the same page above it, back to the row before, come before its own words; notes below it, up to the next row
    of the statement, follow. Text below a page's last row belongs to nothing. Descriptions are put in logical order and
    cut at ``longest`` characters, again after each note. Lines are grouped by the row that they belong to, in one pass.
    """
    all_lines = printed_lines(words, layout)
    is_row, is_text, is_note = (F.col("kind") == k for k in ("row", "text", "note"))
    belongs = all_lines.where(is_row | is_text | is_note).withColumn("row_no", F.col("above") + F.when(is_note, 0).otherwise(1))
    pending, notes = F.struct("page", "line", "text"), F.struct("page", "line", "logical")
    rows = belongs.groupBy("statement", "row_no").agg(F.max_by(F.struct("page", "day", "cells", "said"), F.when(is_row, 1)).alias("r"), F.array_sort(F.collect_list(F.when(is_text, pending))).alias("pending"), F.array_sort(F.collect_list(F.when(is_note, notes))).alias("notes"))
    rows = rows.where("r IS NOT NULL").select("statement", "row_no", "r.*", "notes", F.filter("pending", lambda t: t.page == F.col("r.page")).alias("pending"))
    value = lambda i: F.regexp_replace(F.get("cells", F.lit(i)), ",", "").try_cast(MONEY)
    credited = value(1) != 0
    words_ = F.array_join(F.concat(F.col("pending.text"), F.col("said")), " ")
    rows = rows.withColumn("_said", logical_order(words_))
    own = F.substring("_said", 1, layout.longest)
    full = F.aggregate(F.col("notes.logical"), own, lambda acc, n: _stripped(F.substring(F.concat(acc, F.lit(" "), n), 1, layout.longest)))
    description = F.when(full != "", full)
    return rows.select("statement", "page", F.col("row_no").cast("int").alias("row_no"), F.col("day").alias("date"), F.when(credited, value(1)).otherwise(value(0)).alias("movement"), value(2).alias("balance"), description.alias("description"), F.when(credited, F.get("cells", F.lit(1))).otherwise(F.get("cells", F.lit(0))).alias("raw_movement"), F.get("cells", F.lit(2)).alias("raw_balance"))

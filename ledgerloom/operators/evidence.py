"""Evidence: merging what several readers saw, and what a statement's answers rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.texts import query_terms
from ledgerloom.operators.search import bm25

MONEY = "decimal(18,2)"
PAGE = ["statement", "page"]


def both_columns(rows: DataFrame, amount: str = "derived") -> DataFrame:
    """One amount as two columns by side; zero and the other side are null."""
    of = lambda s: F.when((F.col("side") == s) & (F.col(amount) != 0), F.col(amount))
    return rows.withColumns({"debit": of("debit"), "credit": of("credit")})


def moving_rows(rows: DataFrame) -> DataFrame:
    """By page: rows that move money, without opening ones, zero steps and unread amounts."""
    return rows.groupBy(PAGE).agg(F.count_if(~F.col("opening") & F.coalesce(F.col("derived") != 0, F.lit(False))).alias("moving"))


def simple_chain(rows: DataFrame) -> DataFrame:
    """The older chain without pages: step, sign and check of each row against the one before it; the first is opening."""
    order = Window.partitionBy("statement").orderBy("seq")
    step = (F.col("balance") - F.lag("balance").over(order)).cast(MONEY)
    rows = rows.withColumn("step", step)
    m, gap = F.col("movement"), F.abs("step")
    check = F.when(F.row_number().over(order) == 1, "opening").when(F.col("step").isNull() | m.isNull(), "unread").when(m == gap, "ok").when((m == gap * 100) | (m * 100 == gap), "scale").otherwise("broken")
    return rows.withColumns({"sign": F.signum(F.col("step").cast("double")).cast("int"), "check": check})


def side_by_chain(rows: DataFrame) -> DataFrame:
    """keep, flip or unknown: whether the printed side or the other one leads from the balance before to this one."""
    before = F.lag("balance").over(Window.partitionBy("statement").orderBy("seq"))
    signed = F.when(F.col("printed_side") == "credit", F.col("movement")).otherwise(-F.col("movement"))
    given, other = before + signed == F.col("balance"), before - signed == F.col("balance")
    known = F.col("printed_side").isNotNull()
    return rows.withColumn("decision", F.when(known & given, "keep").when(known & other, "flip").otherwise("unknown"))


def raw_and_derived(raw: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows as read beside what the chain gave, by page and row number; either may lack a row."""
    a = raw.select(*PAGE, "row_no", F.col("movement").alias("read"))
    return a.join(derived.select(*PAGE, "row_no", "derived"), [*PAGE, "row_no"], "full")


def merge_descriptions(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Descriptions of a second reader replace ours page by page, only where both have as many rows with a balance.

    Rows are paired in order among those with a balance; an empty text never replaces one; the old text is kept.
    """
    place = Window.partitionBy(PAGE).orderBy("row_no")
    read = rows.where("balance IS NOT NULL").withColumn("k", F.row_number().over(place)).select(*PAGE, "row_no", "k")
    other = sidecar.withColumn("k", F.row_number().over(place)).select(*PAGE, "k", F.col("description").alias("_new"))
    fits = read.groupBy(PAGE).agg(F.max("k").alias("n")).join(other.groupBy(PAGE).agg(F.max("k").alias("n")), [*PAGE, "n"]).select(*PAGE)
    new = read.join(fits, PAGE, "left_semi").join(other, [*PAGE, "k"]).select(*PAGE, "row_no", F.nullif(F.trim("_new"), F.lit("")).alias("_new"))
    merged = rows.join(new, [*PAGE, "row_no"], "left")
    return merged.withColumns({"old_description": F.when(F.col("_new").isNotNull(), F.col("description")), "description": F.coalesce("_new", "description")}).drop("_new")


def pair_overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """By page: distinct (movement, balance) pairs of both readers and how many they share."""
    pairs = lambda t, n: t.where("movement IS NOT NULL AND balance IS NOT NULL").select(*PAGE, "movement", "balance").distinct().withColumn(n, F.lit(1))
    both = pairs(one, "a").join(pairs(other, "b"), [*PAGE, "movement", "balance"], "full")
    return both.groupBy(PAGE).agg(F.count("a").alias("n_one"), F.count("b").alias("n_other"), F.count(F.col("a") + F.col("b")).alias("shared"))


def cell_compare(one: DataFrame, other: DataFrame, cells: tuple[str, ...] = ("date", "movement", "balance")) -> DataFrame:
    """cell, result, n: agree, differ, unread (only we lack it) or absent (the other reader lacks it), by cell."""
    a = one.select(*PAGE, "row_no", *[F.col(c).cast("string").alias(c) for c in cells])
    b = other.select(*PAGE, "row_no", *[F.col(c).cast("string").alias("o_" + c) for c in cells])
    both = a.join(b, [*PAGE, "row_no"], "left")
    result = lambda c: F.when(F.col("o_" + c).isNull(), "absent").when(F.col(c).isNull(), "unread").when(F.col(c) == F.col("o_" + c), "agree").otherwise("differ")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), result(c).alias("result")) for c in cells])).alias("x"))
    return long.groupBy("x.cell", "x.result").agg(F.count("*").alias("n"))


def without_pages(rows: DataFrame, reserved: DataFrame) -> DataFrame:
    """Rows of pages that aren't reserved."""
    return rows.join(reserved.select(*PAGE).distinct(), PAGE, "left_anti")


def overlap(pack: DataFrame, training: DataFrame) -> DataFrame:
    """n, passed: pages that stand in both; there must be none."""
    return pack.select(*PAGE).intersect(training.select(*PAGE)).agg(F.count("*").alias("n")).withColumn("passed", F.col("n") == 0)


def provenance(stored: DataFrame, raw: DataFrame, arbitrated: DataFrame, value: str = "movement") -> DataFrame:
    """Rows whose stored value isn't the parsed one, and whether an arbitration record of the page justifies it."""
    both = stored.select(*PAGE, "row_no", F.col(value).alias("stored")).join(raw.select(*PAGE, "row_no", F.col(value).alias("parsed")), [*PAGE, "row_no"])
    both = both.where("NOT (stored <=> parsed)").join(arbitrated.select(*PAGE).distinct().withColumn("_a", F.lit(True)), PAGE, "left")
    return both.select(*PAGE, "row_no", "stored", "parsed", F.coalesce("_a", F.lit(False)).alias("justified"))


def cross_check(verdicts: DataFrame) -> DataFrame:
    """Own page sums beside what the printed totals say the page added, only where those decide."""
    step = lambda p: (F.col(p) - F.col(f"before_{p}")).cast(MONEY)
    rows = verdicts.where("delta_check <> 'unchecked'")
    return rows.select(*PAGE, "own_debits", step("debits").alias("printed_debits"), "own_credits", step("credits").alias("printed_credits"), (F.col("delta_check") == "ok").alias("same"))


def breakdown(lines: DataFrame) -> DataFrame:
    """Parts before each printed total must sum to it. lines: statement, pos, label (null: a part), amount."""
    down = Window.partitionBy("statement").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rows = lines.withColumn("_total", F.first(F.when(F.col("label").isNotNull(), F.col("pos")), ignorenulls=True).over(down)).where("_total IS NOT NULL")
    part = F.col("label").isNull()
    out = rows.groupBy("statement", "_total").agg(F.max("label").alias("label"), F.coalesce(F.sum(F.when(part, F.col("amount"))), F.lit(0)).cast(MONEY).alias("parts"), F.max(F.when(~part, F.col("amount"))).alias("total"))
    return out.select("statement", F.col("_total").alias("pos"), "label", "parts", "total", (F.col("parts") == F.col("total")).alias("holds"))


def changes(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Rows at which ``state`` differs from the row before (the first counts as a change)."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("was", before).where(~F.col(state).eqNullSafe(F.col("was")))


def first_page_unchecked(verdicts: DataFrame) -> DataFrame:
    """A partial run that doesn't begin at page 1 can't check its first page: its totals hold what came before."""
    first = F.row_number().over(Window.partitionBy("statement").orderBy("page")) == 1
    return verdicts.withColumn("verdict", F.when(first & (F.col("page") > 1) & (F.col("verdict") != "absent"), "unchecked").otherwise(F.col("verdict")))


def verdict_label(verdicts: DataFrame, rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The verdict of each page; a page without rows is named by its kind, not as a defect."""
    n = rows.groupBy(PAGE).agg(F.count("*").alias("n"))
    out = verdicts.join(n, PAGE, "left").join(kinds.select(*PAGE, "kind"), PAGE, "left")
    return out.select(*PAGE, F.when(F.coalesce("n", F.lit(0)) == 0, F.coalesce("kind", F.lit("empty"))).otherwise(F.col("verdict")).alias("label"))


def window_price(pages: DataFrame, length: int) -> DataFrame:
    """The best run of ``length`` consecutive pages of each statement by ``free`` pages, and what it holds; the earliest of equals."""
    order = Window.partitionBy("statement").orderBy("page")
    span = order.rowsBetween(0, length - 1)
    rows = pages.withColumns({"free_pages": F.sum(F.col("free").cast("long")).over(span), "n": F.count("*").over(span), "last": F.max("page").over(span)})
    rows = rows.where((F.col("n") == length) & (F.col("last") - F.col("page") == length - 1))
    best = Window.partitionBy("statement").orderBy(F.desc("free_pages"), "page")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("statement", F.col("page").alias("from_page"), "free_pages")


def search_statements(rows: DataFrame, question: str, k: int = 10) -> DataFrame:
    """The ``k`` best rows for a question, by BM25 over descriptions; signs of the question are no operators."""
    terms = rows.sparkSession.range(1).select(query_terms(F.lit(question)).alias("t")).first().t
    docs = rows.select(F.concat_ws("-", "statement", "seq").alias("row_key"), F.coalesce("description", F.lit("")).alias("text"))
    return bm25(docs, terms, k, doc_id="row_key").withColumnRenamed("doc_id", "row_key")


def rows_cited(cited: DataFrame, rows: DataFrame, most: int = 60) -> DataFrame:
    """The rows of each citation (question, statement, page or null, first, last), the first ``most`` of a question."""
    c, r = cited.alias("c"), rows.alias("r")
    met = c.join(r, (F.col("c.statement") == F.col("r.statement")) & (F.col("c.page").isNull() | (F.col("c.page") == F.col("r.page"))) & F.col("r.row_no").between(F.col("c.first"), F.col("c.last")))
    met = met.select("c.question", "r.statement", "r.page", "r.row_no", "r.seq").distinct()
    order = Window.partitionBy("question").orderBy("statement", "seq")
    return met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def flags(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """By statement: whether a rewrite is allowed, and every reason against it, in order of name."""
    marks = rows.groupBy("statement").agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in reasons.items()])
    against = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in sorted(reasons)]))
    return marks.select("statement", (F.size(against) == 0).alias("allowed"), F.array_join(against, ",").alias("reasons"))


def stability(runs: DataFrame) -> DataFrame:
    """question, runs, always, ever: over questions that every arm has answered (runs: question, arm, passed)."""
    arms = runs.select("arm").distinct().agg(F.count("*").alias("arms"))
    out = runs.groupBy("question").agg(F.count_distinct("arm").alias("runs"), F.bool_and("passed").alias("always"), F.bool_or("passed").alias("ever"))
    return out.join(F.broadcast(arms), F.col("runs") == F.col("arms")).drop("arms")  # one row


def answers(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """question, statement, answer: the fixed questions, each answered for every statement by its named operator."""
    m = rows.where("NOT opening")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("derived"))), F.lit(0)).cast(MONEY)
    facts = m.groupBy("statement").agg(
        F.count("*").alias("movements"), side("debit").alias("debits"), side("credit").alias("credits"), F.max("derived").alias("largest"), F.count_if(F.col("derived").isNull()).alias("without_amount"),
        F.count_if(~F.col("ok")).alias("broken"), F.min("iso").alias("first_day"), F.max("iso").alias("last_day"), F.count_if(F.col("iso").isNull()).alias("undated"),
    )
    closing = rows.where("balance IS NOT NULL").groupBy("statement").agg(F.max_by("balance", "seq").alias("closing"), F.min_by("balance", "seq").alias("opening"), F.max("balance").alias("highest"), F.min("balance").alias("lowest"))
    pages = verdicts.groupBy("statement").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "ok").alias("pages_ok"))
    wide = facts.join(closing, "statement", "full").join(pages, "statement", "full")
    names = [c for c in wide.columns if c != "statement"]
    return wide.select("statement", F.inline(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).cast("string").alias("answer")) for c in names])))

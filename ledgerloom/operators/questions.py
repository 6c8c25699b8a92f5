"""Questions and answers: what a statement can answer, which pages to fetch, what an answer must disclose, and the log.

The words that tell questions apart are the caller's (``Vocabulary``); facts come from the rows by joins, so that neither the amounts
nor the pages of a statement are gathered in one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import page_mentions, search_form
from ledgerloom.functions.texts import amounts_in_text, years_in_text


@dataclass(frozen=True)
class Vocabulary:
    """Words in search form. Names in ``weak`` mean another institution only beside a word of ``institution``."""

    own: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    institution: tuple[str, ...] = ("bank",)
    personal: tuple[str, ...] = ("phone number", "home address", "date of birth", "passport")
    existence: tuple[str, ...] = ("is there", "was there", "did i", "any payment")
    comparison: tuple[str, ...] = ("more than", "less than", "over", "under", "above", "below", "between", "exceed")
    closing: tuple[str, ...] = ("closing balance", "final balance", "last balance", "balance at the end")


def _names(text: Column, words: tuple[str, ...], whole: bool = True) -> Column:
    if not words:
        return F.lit(False)
    some = "|".join(r"\Q" + w + r"\E" for w in words)
    return F.coalesce(text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{some})(?![\p{{L}}\p{{N}}_])" if whole else some), F.lit(False))


def data_facts(rows: DataFrame, last_pages: DataFrame) -> DataFrame:
    """statement, years (of its dated rows), max_page (with rows), n_pages (of the document, null if unknown).

    rows: statement, page, iso; last_pages: statement, n_pages.
    """
    own = rows.groupBy("statement").agg(F.array_sort(F.collect_set(F.substring("iso", 1, 4))).alias("years"), F.max("page").alias("max_page"))
    return own.join(last_pages, "statement", "left")


def decide_scope(questions: DataFrame, rows: DataFrame, last_pages: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """question, statement, scope, about: whether a statement can answer, and what stands against it.

    questions: question, statement, text; rows: statement, page, iso, amount. The first that holds: other_entity (named, and
    the own one isn't), personal_data, year_outside (a year without dated rows), page_outside (beyond the document's last),
    page_unread (in the document, but without rows), amount_absent (an amount that no row has; only for questions of its
    existence that compare nothing), in_scope. Facts that are unknown refuse nothing; a null text is in scope.
    """
    t = search_form(F.col("text"))
    q = questions.select("question", "statement", t.alias("t"), years_in_text(F.col("text")).alias("asked_years"), page_mentions(F.col("text")).alias("asked_pages"), amounts_in_text(F.col("text")).alias("asked_amounts"))
    q = q.join(data_facts(rows, last_pages), "statement", "left")
    weak = _names(F.col("t"), words.weak) & _names(F.col("t"), words.institution)
    other = ~_names(F.col("t"), words.own) & (_names(F.col("t"), words.strong) | weak)
    unknown_year = F.get(F.filter("asked_years", lambda y: ~F.array_contains("years", y)), F.lit(0))
    asked = F.posexplode("asked_pages").alias("i", "page")
    first = lambda df, c: df.groupBy("question", "statement").agg(F.min(F.struct("i", c)).alias("_f")).select("question", "statement", F.col(f"_f.{c}").alias(f"_{c}"))
    seen = rows.select("statement", "page").distinct()
    unread = first(q.select("question", "statement", asked).join(seen, ["statement", "page"], "left_anti"), "page")
    exists = _names(F.col("t"), words.existence) & ~_names(F.col("t"), words.comparison)
    amounts = rows.select("statement", "amount").distinct()
    absent = first(q.where(exists).select("question", "statement", F.posexplode("asked_amounts").alias("i", "amount")).join(amounts, ["statement", "amount"], "left_anti"), "amount")
    q = q.join(unread, ["question", "statement"], "left").join(absent, ["question", "statement"], "left")
    outside = F.get(F.filter("asked_pages", lambda p: p > F.col("n_pages")), F.lit(0))
    some_rows = F.col("max_page").isNotNull()
    scope = F.when(other, "other_entity").when(_names(F.col("t"), words.personal, whole=False), "personal_data").when((F.size("years") > 0) & unknown_year.isNotNull(), "year_outside").when(outside.isNotNull(), "page_outside").when(some_rows & F.col("_page").isNotNull(), "page_unread").when(some_rows & F.col("_amount").isNotNull(), "amount_absent").otherwise("in_scope")
    about = F.when(scope == "year_outside", unknown_year).when(scope == "page_outside", outside.cast("string")).when(scope == "page_unread", F.col("_page").cast("string")).when(scope == "amount_absent", F.col("_amount").cast("string"))
    return q.select("question", "statement", scope.alias("scope"), about.alias("about"))


def pages_to_fetch(questions: DataFrame, rows: DataFrame, words: Vocabulary = Vocabulary()) -> DataFrame:
    """question, statement, pages: those that a text names; the last page with rows for a question of the closing balance; else none."""
    last = rows.groupBy("statement").agg(F.max("page").alias("_last"))
    closing = _names(search_form(F.col("text")), words.closing, whole=False) & F.col("_last").isNotNull()
    named, none = F.coalesce(page_mentions(F.col("text")), F.array().cast("array<int>")), F.array().cast("array<int>")
    out = questions.join(last, "statement", "left")
    return out.select("question", "statement", F.when(F.size(named) > 0, named).when(closing, F.array(F.col("_last").cast("int"))).otherwise(none).alias("pages"))


#: What stands before an answer that wasn't computed to its end, in the order in which one is chosen.
NOTICES = {
    "truncated": "The answer was cut off before its end. What the tools computed stands below; don't rely on a number in the text.",
    "limit_hit": "The question took more steps than are allowed and was not computed to its end. Don't rely on a number in it.",
    "tools_failed": "The tools failed. This answer is a description and was not computed from the statement.",
    "ungrounded": "This answer has numbers that no tool computed. Don't rely on them.",
}


def disclosed(answers: DataFrame, used: DataFrame, verdicts: DataFrame) -> DataFrame:
    """question, notice, pages, evidence, text: what a reader gets.

    answers: question, statement, answer and the flags of NOTICES (null: no); also typed (whether citations were given as
    numbers of rows) and cited (array of rows). used: question, statement, page of the rows that tools touched; verdicts:
    statement, page, verdict. notice: the first flag that holds, else pages if a used page's verdict isn't ok, whose numbers
    and verdicts then follow the answer. evidence: none (nothing was computed), typed, tools (used rows) or fallback.
    """
    touched = used.select("question", "statement", "page").distinct()
    doubtful = touched.join(verdicts.select("statement", "page", "verdict"), ["statement", "page"]).where("verdict <> 'ok'")
    doubtful = doubtful.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("page", "verdict"))).alias("_doubtful"))
    rows = answers.join(touched.select("question").distinct().withColumn("_used", F.lit(True)), "question", "left").join(doubtful, "question", "left")
    holds = lambda c: F.coalesce(F.col(c), F.lit(False))
    flag = F.coalesce(*[F.when(holds(n), n) for n in NOTICES])
    notice = F.coalesce(flag, F.when(F.size("_doubtful") > 0, "pages"))
    body = F.coalesce("answer", F.lit(""))
    said = F.coalesce(*[F.when(flag == n, F.concat(F.lit(text + "\n\n"), body)) for n, text in NOTICES.items()])
    listed = F.array_join(F.transform("_doubtful", lambda d: F.concat(F.lit("page "), d.page.cast("string"), F.lit(": "), d.verdict)), "; ")
    text = F.when(flag.isNotNull(), said).when(notice == "pages", F.concat(body, F.lit("\n\nNot proven: "), listed)).otherwise(body)
    evidence = F.when(holds("tools_failed") | holds("ungrounded"), "none").when(holds("typed") & (F.size("cited") > 0), "typed").when(F.coalesce("_used", F.lit(False)), "tools").otherwise("fallback")
    pages = F.when(notice == "pages", F.col("_doubtful.page")).otherwise(F.array().cast("array<int>"))
    return rows.select("question", notice.alias("notice"), pages.alias("pages"), evidence.alias("evidence"), text.alias("text"))


def log_entries(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that a log of questions gets: qa (qa_id, asked_at, question, answer, refused) and evidence (qa_id, row_id).

    asked: asked_at, question, answer, refused (null: no), row_ids. The id is a hash of what was asked, answered and when, so
    an entry that is written again after a crash is the same one. Null and repeated evidence rows are left out.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    each = asked.withColumn("qa_id", F.substring(F.sha2(F.concat_ws("|", *[cell(c) for c in ("asked_at", "question", "answer")]), 256), 1, 16))
    qa = each.select("qa_id", "asked_at", "question", "answer", F.coalesce("refused", F.lit(False)).alias("refused")).distinct()
    return qa, each.select("qa_id", F.explode("row_ids").alias("row_id")).where("row_id IS NOT NULL").distinct()

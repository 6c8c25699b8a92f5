"""Queries over questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import questions
from ledgerloom.plans.registry import chained, query, reconciled, with_base
from ledgerloom.sources import statements

WORDS = questions.Vocabulary(own=("ledgerloom bank",), strong=("northwind",), weak=("fabrikam",))
#: Questions; {p} a page, {q} the page after, {a} an amount, {y} a year.
ASKED = ("What did I pay to Northwind in {y}?", "Tell me the phone number of the holder", "Total of {y} and 1999", "Sum of page 500", "Rows of page {q}", "Is there a payment of {a}?", "Was there a fee of 123,456.78?", "Payments over 123,456.78", "Did I spend more than 99.99?", "The closing balance?", "Did Fabrikam pay in {y}?", "A fee of Fabrikam bank on page {p}", "From Ledgerloom Bank to Northwind Bank on page {p}", "Is there a payment of {a} or 0.01 on page {p}?", "Pages {p} and {q}, and 1998?")


def asked(spark, d):
    e = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(a) for a in ASKED]), (e % len(ASKED) + 1).cast("int"))
    for name, value in (("p", F.col("page").cast("string")), ("q", (F.col("page") + 1).cast("string")), ("a", F.format_number(F.col("cents") / 100, 2)), ("y", F.date_format("day", "yyyy"))):
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return statements.true_movements(statements.events(spark, d)).select(e.alias("question"), "statement", text.alias("text"))


def facts(spark, d):
    rows = chained(spark, d).select("statement", "page", scalars.iso_date(F.col("date")).alias("iso"), F.col("derived").alias("amount"))
    last = statements.true_movements(statements.events(spark, d)).groupBy("statement").agg(F.max("page").alias("n_pages"))
    return rows, last


ASKED_SQL = ", qa0 AS (SELECT event_id AS question, statement, replace(replace(replace(replace([" + ", ".join(f"'{a}'" for a in ASKED) + f"][event_id % {len(ASKED)} + 1], '{{p}}', page::VARCHAR), '{{q}}', (page + 1)::VARCHAR), '{{a}}', format('{{:,.2f}}', cents / 100.0)), '{{y}}', strftime(day, '%Y')) AS text FROM tm), qa1 AS (SELECT *, lower(text) AS t, list_transform(regexp_extract_all(text, '[Pp]ages? ([0-9]+)(?: and ([0-9]+))?', 1), lambda x: x::INT) AS p1, list_transform(list_filter(regexp_extract_all(text, '[Pp]ages? [0-9]+ and ([0-9]+)', 1), lambda x: x <> ''), lambda x: x::INT) AS p2 FROM qa0), qa2 AS (SELECT *, list_sort(list_concat(p1, p2)) AS pages FROM qa1)"


@query(with_base(ASKED_SQL + r""", fa AS (SELECT statement, list(DISTINCT iso[1:4]) FILTER (iso IS NOT NULL) AS years, max(page) AS max_page FROM ci GROUP BY 1), fn AS (SELECT statement, max(page) AS n_pages FROM tm GROUP BY 1),
 fp AS (SELECT qa2.*, years, max_page, n_pages, list_filter(regexp_extract_all(t, '(?:^|[^0-9.,])((?:19|20)[0-9][0-9])(?:[^0-9.,]|$)', 1), lambda y: NOT list_contains(years, y))[1] AS bad_year, list_filter(pages, lambda p: p > n_pages)[1] AS out_page, list_transform(regexp_extract_all(t, '[0-9,]+\.[0-9][0-9]'), lambda x: replace(x, ',', '')::DECIMAL(18,2)) AS amounts FROM qa2 LEFT JOIN fa USING (statement) LEFT JOIN fn USING (statement)),
 up AS (SELECT question, min(p) AS p FROM (SELECT question, statement, unnest(pages) AS p FROM fp) u WHERE NOT EXISTS (SELECT 1 FROM srows r WHERE r.statement = u.statement AND r.page = u.p) GROUP BY 1),
 ua AS (SELECT question, arg_min(a, i) AS a FROM (SELECT question, statement, unnest(amounts) AS a, generate_subscripts(amounts, 1) AS i FROM fp WHERE regexp_matches(t, 'is there|was there|did i|any payment') AND NOT regexp_matches(t, 'more than|over|under')) u WHERE NOT EXISTS (SELECT 1 FROM chain r WHERE r.statement = u.statement AND r.derived = u.a) GROUP BY 1),
 sc AS (SELECT fp.*, up.p AS unread, ua.a AS absent, CASE WHEN NOT contains(t, 'ledgerloom bank') AND (contains(t, 'northwind') OR contains(t, 'fabrikam') AND contains(t, 'bank')) THEN 'other_entity' WHEN contains(t, 'phone number') THEN 'personal_data' WHEN bad_year IS NOT NULL THEN 'year_outside' WHEN out_page IS NOT NULL THEN 'page_outside' WHEN up.p IS NOT NULL THEN 'page_unread' WHEN ua.a IS NOT NULL THEN 'amount_absent' ELSE 'in_scope' END AS scope FROM fp LEFT JOIN up USING (question) LEFT JOIN ua USING (question))
 SELECT question, statement, scope, CASE scope WHEN 'year_outside' THEN bad_year WHEN 'page_outside' THEN out_page::VARCHAR WHEN 'page_unread' THEN unread::VARCHAR WHEN 'amount_absent' THEN absent::VARCHAR END AS about FROM sc"""))
def scope_decision(spark, d):
    rows, last = facts(spark, d)
    return questions.decide_scope(asked(spark, d), rows, last, WORDS)


@query(with_base(ASKED_SQL + ", lp AS (SELECT statement, max(page) AS last FROM srows GROUP BY 1) SELECT question, statement, array_to_string(CASE WHEN len(pages) > 0 THEN pages WHEN contains(t, 'closing balance') THEN [last] ELSE [] END, ',') AS pages FROM qa2 LEFT JOIN lp USING (statement)"))
def fetched_pages(spark, d):
    rows, _ = facts(spark, d)
    return questions.pages_to_fetch(asked(spark, d), rows, WORDS).withColumn("pages", F.array_join("pages", ","))


def answered(spark, d):
    """One answer for each statement's page with a row number of five: flags and typed citations by rule, and the rows its tools touched."""
    rows = chained(spark, d).select("statement", "page", "seq", "row_no")
    s, k = F.col("statement"), F.col("statement") + F.col("page")
    answers = rows.where("row_no = 5").select((s * 1000 + F.col("page")).alias("question"), "statement", F.when(k % 17 != 3, F.concat(F.lit("It is "), k.cast("string"))).alias("answer"), (k % 11 == 1).alias("truncated"), F.when(k % 7 == 2, True).alias("limit_hit"), (k % 5 == 0).alias("tools_failed"), (k % 13 == 4).alias("ungrounded"), (k % 3 == 0).alias("typed"), F.when(k % 2 == 0, F.array("seq")).otherwise(F.array().cast("array<int>")).alias("cited"))
    used = rows.where("row_no BETWEEN 2 AND 3 AND (statement + page) % 4 <> 1").select((s * 1000 + F.col("page")).alias("question"), "statement", "page")
    return answers, used.unionByName(used.where("page > 1").withColumn("page", F.col("page") - 1))


@query(with_base(""", an AS (SELECT statement * 1000 + page AS question, statement, page, statement + page AS k FROM chain WHERE row_no = 5), us AS (SELECT DISTINCT statement * 1000 + page AS question, statement, page - i AS page FROM chain, (VALUES (0), (1)) t(i) WHERE row_no BETWEEN 2 AND 3 AND (statement + page) % 4 <> 1 AND page - i >= 1),
 db AS (SELECT question, list(us.page ORDER BY us.page) AS pages, string_agg('page ' || us.page || ': ' || verdict, '; ' ORDER BY us.page) AS listed FROM us JOIN vd USING (statement, page) WHERE verdict <> 'ok' GROUP BY 1),
 nt AS (SELECT an.*, pages, listed, CASE WHEN k % 17 <> 3 THEN 'It is ' || k ELSE '' END AS body, CASE WHEN k % 11 = 1 THEN 'truncated' WHEN k % 7 = 2 THEN 'limit_hit' WHEN k % 5 = 0 THEN 'tools_failed' WHEN k % 13 = 4 THEN 'ungrounded' WHEN pages IS NOT NULL THEN 'pages' END AS notice FROM an LEFT JOIN db USING (question))
 SELECT question, notice, CASE WHEN notice = 'pages' THEN array_to_string(pages, ',') ELSE '' END AS pages, CASE WHEN k % 5 = 0 OR k % 13 = 4 THEN 'none' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'typed' WHEN question IN (SELECT question FROM us) THEN 'tools' ELSE 'fallback' END AS evidence,
  CASE notice """ + " ".join(f"WHEN '{n}' THEN '{t.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || body" for n, t in questions.NOTICES.items()) + """ WHEN 'pages' THEN body || chr(10) || chr(10) || 'Not proven: ' || listed ELSE body END AS text FROM nt"""))
def disclosed_answers(spark, d):
    answers, used = answered(spark, d)
    return questions.disclosed(answers, used, reconciled(spark, d)).withColumn("pages", F.array_join("pages", ","))


@query(with_base(""", lg AS (SELECT '2024-02-01' AS asked_at, 'q' || page AS question, CASE WHEN statement % 4 <> 0 THEN 'a' || statement END AS answer, statement % 4 = 0 AS refused, list(CASE WHEN seq % 3 <> 0 THEN seq // 2 END) AS ids FROM chain GROUP BY statement, page),
 li AS (SELECT *, sha256(concat_ws('|', len(asked_at) || ':' || asked_at, len(question) || ':' || question, coalesce(len(answer) || ':' || answer, '-')))[1:16] AS qa_id FROM lg)
 SELECT qa_id, any_value(question) AS question, any_value(answer) AS answer, any_value(refused) AS refused, count(DISTINCT id) AS evidence FROM (SELECT qa_id, question, answer, refused, unnest(ids) AS id FROM li) GROUP BY 1"""))
def question_log(spark, d):
    rows = chained(spark, d).groupBy("statement", "page").agg(F.collect_list("seq").alias("s"))
    ids = F.transform("s", lambda x: F.when(x % 3 != 0, F.floor(x / 2).cast("long")))
    said = rows.select(F.lit("2024-02-01").alias("asked_at"), F.concat(F.lit("q"), "page").alias("question"), F.when(F.col("statement") % 4 != 0, F.concat(F.lit("a"), "statement")).alias("answer"), F.when(F.col("statement") % 4 == 0, True).alias("refused"), ids.alias("row_ids"))
    qa, evidence = questions.log_entries(said)
    return qa.join(evidence, "qa_id", "left").groupBy("qa_id", "question", "answer", "refused").agg(F.count("row_id").alias("evidence"))

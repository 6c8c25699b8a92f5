"""Queries over evidence, arguments and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars, texts
from ledgerloom.operators import audits, evidence, tools
from ledgerloom.plans.registry import chained, moved, query, reconciled, with_base
from ledgerloom.sources import shared, statements

_MONEY = "DECIMAL(18,2)"


def rows_of(spark, d):
    return statements.statement_rows(statements.events(spark, d))


def dated(spark, d):
    return chained(spark, d).withColumn("iso", scalars.iso_date(F.col("date")))


# arguments and questions


@query(with_base("SELECT statement, seq, derived FROM mv WHERE side = 'debit' AND contains(lower(description), 'a') AND description LIKE 'Card payment%' AND page <= 3 AND page = 2 AND iso BETWEEN '2024-01-02' AND '2024-12-30'"))
def movement_filter(spark, d):
    return tools.select(moved(spark, d), side="out", keyword="A", kind="card", amount="not an amount", page=2, since="2024-01-02", until="2024-12-30").where("page <= 3").select("statement", "seq", "derived")


@query(with_base("SELECT statement, seq FROM mv WHERE derived = 1250.00 OR derived = (SELECT max(derived) FROM mv)"))
def amount_filter(spark, d):
    """The chain is derived once: rows that hold their statement's largest amount, or the one asked for, are kept, and both answers come from these."""
    rows = moved(spark, d).withColumn("_most", F.max("derived").over(Window.partitionBy("statement")))
    wanted = (F.col("derived") == F.col("_most")) | (F.col("derived") == texts.amount_argument(F.lit("1,250")))
    rows = shared.kept(rows.where(wanted).select("statement", "seq", "derived"))
    top = rows.agg(F.max("derived").alias("derived"))  # one row
    most = rows.join(F.broadcast(top), "derived").select("statement", "seq")
    return tools.select(rows, amount="1,250").select("statement", "seq").unionByName(most).distinct()


@query(with_base(""", a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1,234.5' WHEN 1 THEN '1234' WHEN 2 THEN 'all' WHEN 3 THEN '12 500.25' ELSE '' END AS given FROM tm)
 SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1234.50 WHEN 1 THEN 1234 WHEN 3 THEN 12500.25 END::DECIMAL(18,2) AS amount FROM a"""))
def amount_argument(spark, d):
    k = F.col("event_id") % 5
    given = F.when(k == 0, "1,234.5").when(k == 1, "1234").when(k == 2, "all").when(k == 3, "12 500.25").otherwise("")
    return statements.events(spark, d).select("event_id", texts.amount_argument(given).alias("amount"))


#: Forms of a printed number; {} is its whole part, four digits.
FORMS = ("{},25", "1,{}", "{}.50", "1.2.3", "{}.5", "1.{},75", "1,{}.75", "{}-", "-{},5", " {} ", "SAR {}", "12.345", "{}٫25", "١٬{},50", "٣٠٠,{}", "٣,{},25", "۱۲,۵۰", ".25", "abc.,", ". ,", ".", "{},", "1,{}5", "")


def printed_forms(spark, d):
    """event_id, token: the whole part of every amount in one of the forms."""
    n = F.lpad((F.floor(F.col("cents") / 100) % 9000 + 1000).cast("string"), 4, "0")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("event_id") % len(FORMS) + 1).cast("int"))
    return statements.true_movements(statements.events(spark, d)).select("event_id", F.replace(form, F.lit("{}"), n).alias("token"))


#: The tokens again (tf), and with digits as ASCII (l), separators as dots and commas (u).
FORMS_SQL = ", tf AS (SELECT event_id, replace([" + ", ".join(f"'{f}'" for f in FORMS) + f"][event_id % {len(FORMS)} + 1], '{{}}', (cents // 100 % 9000 + 1000)::VARCHAR) AS token FROM tm), tl AS (SELECT *, translate(token, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS l FROM tf), tu AS (SELECT *, translate(l, '٫٬،', '.,,') AS u FROM tl)"


@query(with_base(FORMS_SQL + r""", te AS (SELECT *, regexp_replace(regexp_extract(translate(l, '٫٬', '.'), '-?[0-9.,]+'), '[.,]+$', '') AS e, regexp_replace(replace(l, '٫', '.'), '[^0-9.]', '', 'g') AS w FROM tl)
 SELECT event_id, token, try_cast(replace(CASE WHEN regexp_matches(token, '[٠-٩۰-۹]') AND regexp_full_match(trim(l), '[0-9,]*,[0-9]{2}') THEN regexp_replace(replace(trim(l), ',', ''), '(..)$', '.\1') ELSE replace(trim(l), ',', '') END, '٫', '.') AS DECIMAL(18,2)) AS export,
  try_cast(CASE WHEN regexp_matches(e, '\..*,') AND regexp_matches(e, ',[^.]*$') THEN replace(replace(e, '.', ''), ',', '.') WHEN regexp_matches(e, ',.*\.') THEN replace(e, ',', '') WHEN regexp_matches(e, ',[0-9]{2}$') THEN replace(e, ',', '.') WHEN contains(e, ',') THEN replace(e, ',', '') WHEN regexp_full_match(e, '-?[0-9]*\.[0-9]{3}') THEN replace(e, '.', '') ELSE e END AS DECIMAL(18,2)) AS evaluation,
  CASE WHEN NOT regexp_matches(w, '\..*\.') THEN try_cast(w AS DECIMAL(18,2)) END AS witness FROM te"""))
def number_parsers(spark, d):
    t = F.col("token")
    return printed_forms(spark, d).select("event_id", "token", texts.number_of_export(t).alias("export"), texts.number_of_evaluation(t).alias("evaluation"), texts.number_of_witness(t).alias("witness"))


@query(with_base(FORMS_SQL + r""", ts AS (SELECT *, regexp_replace(u, '[^0-9.,]', '', 'g') AS s FROM tu), tp AS (SELECT *, replace(regexp_extract(s, '^([^.]*)\.', 1), ',', '') AS a, regexp_replace(regexp_extract(s, '^[^.]*\.(.*)$', 1), '[^0-9]', '', 'g') AS b, replace(regexp_extract(s, '^(.*),[^,]*$', 1), ',', '') AS h, regexp_extract(s, ',([^,]*)$', 1) AS t FROM ts),
 tv AS (SELECT *, CASE WHEN regexp_full_match(u, '[\s.,]+') THEN CASE WHEN len(trim(u)) >= 2 THEN '0' END WHEN s = '' THEN NULL WHEN contains(s, '.') THEN CASE WHEN a = '' THEN NULL WHEN len(b) = 2 THEN a || '.' || b WHEN b = '' THEN a END WHEN NOT contains(s, ',') THEN s WHEN len(t) < 2 THEN h WHEN len(t) = 2 THEN h || '.' || t WHEN len(t) = 3 THEN h || t ELSE h || t[:3] || '.' || lpad(t[4:5], 2, '0') END AS v FROM tp)
 SELECT event_id, token, (try_cast(v AS DECIMAL(18,2)) * CASE WHEN regexp_matches(u, '^\s*-|-\s*$') THEN -1 ELSE 1 END)::DECIMAL(18,2) AS amount FROM tv"""))
def amount_forms(spark, d):
    return printed_forms(spark, d).select("event_id", "token", scalars.parse_amount(F.col("token")).alias("amount"))


#: Date cells and texts; {0} year, {1} month, {2} day, {3} day without a leading zero.
CELLS = ("{0}{1}{2}", "{0}/{1}/{2}", " {0}.{1}.{2} ", "{0}-{1}-{3}", "2024-13-01", "2024/02/30", "1444/01/05", "{0}{1}", "٢٠٢٤/٠١/٠٥", "2101-01-01", "20240230", "")
PROSE = ("order 12345 of {0}{1}{2}, paid 20310101", "14450630 or {0}{1}{2}", "no 99991231, 14451301", "no14430105no", "{0}/{1}/{2}", "٢٠٢٤٠١٠٥ and 14460101", "123{0}{1}{2}")


def filled(forms, k, day):
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), (k % len(forms) + 1).cast("int"))
    for i, form in enumerate(("yyyy", "MM", "dd", "d")):
        text = F.replace(text, F.lit(f"{{{i}}}"), F.date_format(day, form))
    return text


def _filled_sql(forms, k):
    text = "[" + ", ".join(f"'{f}'" for f in forms) + f"][{k} % {len(forms)} + 1]"
    for i, form in enumerate(("%Y", "%m", "%d", "%-d")):
        text = f"replace({text}, '{{{i}}}', strftime(day, '{form}'))"
    return text


@query(with_base(f""", c AS (SELECT event_id, translate({_filled_sql(CELLS, 'event_id')}, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS cell, translate({_filled_sql(PROSE, 'event_id')}, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS prose FROM tm),
 p AS (SELECT event_id, string_split(regexp_replace(regexp_replace(trim(cell), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})$', '\\1-\\2-\\3'), '[/.]', '-', 'g'), '-') AS v, list_filter(regexp_extract_all(prose, '[0-9]{{8}}'), lambda x: try_cast(x[5:6] AS INT) BETWEEN 1 AND 12 AND try_cast(x[7:8] AS INT) BETWEEN 1 AND 31) AS r FROM c),
 q AS (SELECT event_id, CASE WHEN len(v) = 3 AND try_cast(v[1] AS INT) BETWEEN 1900 AND 2100 THEN strftime(try_cast(v[1] || '-' || lpad(v[2], 2, '0') || '-' || lpad(v[3], 2, '0') AS DATE), '%Y-%m-%d') END AS iso, list_filter(r, lambda x: x[1:2] IN ('19', '20') AND try_cast(x[1:4] AS INT) <= 2100)[1] AS g, list_filter(r, lambda x: x[1:2] = '14')[1] AS h FROM p)
 SELECT event_id, iso, g[1:4] || '-' || g[5:6] || '-' || g[7:8] AS gregorian, h[1:4] || '-' || h[5:6] || '-' || h[7:8] AS hijri, CASE WHEN iso IS NULL THEN '-' ELSE replace(iso, '-', '/') || CASE WHEN event_id % 2 = 0 THEN '*' ELSE '' END END AS shown FROM q"""))
def further_dates(spark, d):
    e = F.col("event_id")
    rows = statements.true_movements(statements.events(spark, d)).select("event_id", texts.date_of_cell(filled(CELLS, e, "day")).alias("iso"), texts.dates_in_text(filled(PROSE, e, "day")).alias("t"))
    return rows.select("event_id", "iso", "t.gregorian", "t.hijri", texts.date_shown(F.col("iso"), e % 2 == 0).alias("shown"))


@query(with_base("SELECT statement, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) = 2 THEN 'two' WHEN count(*) BETWEEN 3 AND 10 THEN 'few' ELSE 'many' END AS form FROM mv GROUP BY 1"))
def count_forms(spark, d):
    return moved(spark, d).groupBy("statement").agg(F.count("*").alias("n")).select("statement", "n", texts.count_form(F.col("n")).alias("form"))


@query("SELECT event_id, CASE WHEN v < 0 THEN -1 ELSE 1 END * round(abs(v) * 100)::BIGINT AS cents FROM (SELECT event_id, (round(value * 1000)::BIGINT * 0.001::DECIMAL(4,3) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END)::DECIMAL(18,3) AS v FROM events)")
def cents_rounding(spark, d):
    v = (F.round(F.col("value") * 1000).cast("long").cast("decimal(18,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,3)") * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)
    return statements.events(spark, d).select("event_id", texts.cents(v).alias("cents"))


@query(with_base("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'decimal' WHEN 2 THEN 'bool' WHEN 3 THEN 'text' ELSE 'null' END AS kind, CASE WHEN event_id % 5 = 0 THEN cents END AS whole, CASE WHEN event_id % 5 = 1 THEN cents * 0.01::DECIMAL(3,2) END::DECIMAL(18,2) AS number, CASE WHEN event_id % 5 = 2 THEN credit END AS flag FROM tm"))
def typed_cells(spark, d):
    k = F.col("event_id") % 5
    cell = F.when(k == 0, F.col("cents").cast("string")).when(k == 1, statements.money(F.col("cents")).cast("string")).when(k == 2, F.initcap(F.col("credit").cast("string"))).when(k == 3, F.col("label"))
    return statements.true_movements(statements.events(spark, d)).select("event_id", texts.typed_cell(cell).alias("c")).select("event_id", "c.kind", "c.whole", "c.number", "c.flag")


@query(with_base("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(day, '%Y') || ',2019' ELSE '' END AS years, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 2 END::INT AS amounts, event_id % 2 = 1 AS money, event_id % 3 = 0 AS tool, event_id % 3 = 1 AS named FROM tm"))
def question_facts(spark, d):
    e = F.col("event_id")
    head = F.when(e % 3 == 0, "What is the TOTAL").when(e % 3 == 1, "Tell of fees, fee by fee").otherwise("Tell of coffees")
    tail = F.when(e % 2 == 0, F.concat(F.lit(" in "), F.date_format("day", "yyyy"), F.lit(" and 2019? No 20190 nor 3.2019"))).otherwise(" with 1,204.50 or 88.00 paid")
    rows = statements.true_movements(statements.events(spark, d)).withColumn("q", F.concat(head, tail))
    q = F.col("q")
    return rows.select("event_id", F.array_join(texts.years_in_text(q), ",").alias("years"), F.size(texts.amounts_in_text(q)).alias("amounts"), texts.money_shaped(q).alias("money"), texts.needs_tool(q).alias("tool"), texts.mentions(q, "fee").alias("named"))


@query(with_base(r""", t AS (SELECT statement, lower(CASE WHEN statement % 3 = 0 THEN 'See ROWS 9 to 8 and row ' || page ELSE 'As page ' || page || ', in its rows 4 - 2 and page ' || (page + 1) || ': row ' || (page % 5) || ' show, and row 9' END) AS t FROM srows WHERE row_no = 1),
 m AS (SELECT statement, unnest(CASE WHEN contains(t, 'page') THEN regexp_extract_all(t, 'page\s*[0-9]+[^0-9]{0,14}?rows?\s*[0-9]+(?:\s*(?:-|to)\s*[0-9]+)?') ELSE regexp_extract_all(t, 'rows?\s*[0-9]+(?:\s*(?:-|to)\s*[0-9]+)?') END) AS m FROM t),
 n AS (SELECT statement, regexp_matches(m, '^page') AS paged, list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT) AS n FROM m),
 c AS (SELECT statement, CASE WHEN paged THEN n[1] END AS page, list_min(n[1 + paged::INT:]) AS a, list_max(n[1 + paged::INT:]) AS b FROM n),
 r AS (SELECT DISTINCT c.statement AS question, s.statement, s.page, s.row_no, s.seq FROM c JOIN srows s ON c.statement = s.statement AND (c.page IS NULL OR c.page = s.page) AND s.row_no BETWEEN a AND b)
 SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY question ORDER BY statement, seq) <= 60"""))
def cited_rows(spark, d):
    rows, p = rows_of(spark, d), F.col("page")
    bare = F.concat(F.lit("See ROWS 9 to 8 and row "), p)
    paged = F.concat(F.lit("As page "), p, F.lit(", in its rows 4 - 2 and page "), p + 1, F.lit(": row "), p % 5, F.lit(" show, and row 9"))
    said = rows.where("row_no = 1").select("statement", F.when(F.col("statement") % 3 == 0, bare).otherwise(paged).alias("answer"))
    cited = said.select("statement", F.col("statement").alias("question"), F.explode(texts.citations(F.col("answer"))).alias("c")).select("statement", "question", "c.*").distinct()
    return evidence.rows_cited(cited, rows)


@query(with_base(""", d AS (SELECT statement || '-' || seq AS row_key, regexp_extract_all(lower(description), '[a-z0-9]+') AS w FROM chain), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
 h AS (SELECT row_key, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, (SELECT unnest(['transfer', 'received', 'or', 'fee', '7']) AS t)), f AS (SELECT t, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
 SELECT row_key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f USING (t), s WHERE tf > 0 GROUP BY row_key ORDER BY score DESC, row_key LIMIT 10"""))
def search_statements(spark, d):
    return evidence.search_statements(chained(spark, d), '"Transfer* RECEIVED" OR (fee) 7')


@query(with_base(""", f AS (SELECT statement, count(*) AS movements, coalesce(sum(derived) FILTER (side = 'debit'), 0)::DECIMAL(18,2) AS debits, coalesce(sum(derived) FILTER (side = 'credit'), 0)::DECIMAL(18,2) AS credits, max(derived) AS largest, count(*) FILTER (derived IS NULL) AS without_amount, count(*) FILTER (NOT ok) AS broken, min(iso) AS first_day, max(iso) AS last_day, count(*) FILTER (iso IS NULL) AS undated FROM mv GROUP BY 1),
 c AS (SELECT statement, arg_max(balance, seq) AS closing, arg_min(balance, seq) AS opening, max(balance) AS highest, min(balance) AS lowest FROM chain WHERE balance IS NOT NULL GROUP BY 1), p AS (SELECT statement, count(*) AS pages, count(*) FILTER (verdict = 'ok') AS pages_ok FROM vd GROUP BY 1),
 w AS (SELECT * FROM f FULL JOIN c USING (statement) FULL JOIN p USING (statement))
 SELECT statement, q.question, q.answer FROM (SELECT statement, unnest([{question: 'movements', answer: movements::VARCHAR}, {question: 'debits', answer: debits::VARCHAR}, {question: 'credits', answer: credits::VARCHAR}, {question: 'largest', answer: largest::VARCHAR}, {question: 'without_amount', answer: without_amount::VARCHAR}, {question: 'broken', answer: broken::VARCHAR}, {question: 'first_day', answer: first_day}, {question: 'last_day', answer: last_day}, {question: 'undated', answer: undated::VARCHAR}, {question: 'closing', answer: closing::VARCHAR}, {question: 'opening', answer: opening::VARCHAR}, {question: 'highest', answer: highest::VARCHAR}, {question: 'lowest', answer: lowest::VARCHAR}, {question: 'pages', answer: pages::VARCHAR}, {question: 'pages_ok', answer: pages_ok::VARCHAR}]) AS q FROM w)"""))
def fixed_questions(spark, d):
    return evidence.answers(dated(spark, d), reconciled(spark, d))


# rows and columns


@query(with_base("SELECT statement, seq, CASE WHEN side = 'debit' AND derived <> 0 THEN derived END AS debit, CASE WHEN side = 'credit' AND derived <> 0 THEN derived END AS credit FROM chain"))
def debit_credit_columns(spark, d):
    return evidence.both_columns(chained(spark, d)).select("statement", "seq", "debit", "credit")


@query(with_base("SELECT statement, page, count(*) FILTER (NOT opening AND derived <> 0) AS moving FROM chain GROUP BY ALL"))
def moving_rows(spark, d):
    return evidence.moving_rows(chained(spark, d))


@query(with_base("SELECT statement, seq FROM srows WHERE starts_with(description, 'Balance brought forward') OR starts_with(description, 'Total')"))
def not_movements(spark, d):
    r = rows_of(spark, d)
    return r.where(F.col("description").startswith("Balance brought forward") | F.col("description").startswith("Total")).select("statement", "seq")


@query(with_base(""", s AS (SELECT *, (balance - lag(balance) OVER w)::DECIMAL(18,2) AS step, row_number() OVER w AS r FROM srows WINDOW w AS (PARTITION BY statement ORDER BY seq))
 SELECT statement, seq, step, sign(step)::INT AS sign, CASE WHEN r = 1 THEN 'opening' WHEN step IS NULL OR movement IS NULL THEN 'unread' WHEN movement = abs(step) THEN 'ok' WHEN movement = abs(step) * 100 OR movement * 100 = abs(step) THEN 'scale' ELSE 'broken' END AS "check" FROM s"""))
def simple_chain(spark, d):
    return evidence.simple_chain(rows_of(spark, d)).select("statement", "seq", "step", "sign", "check")


@query(with_base(""", s AS (SELECT *, lag(balance) OVER (PARTITION BY statement ORDER BY seq) AS b FROM srows), t AS (SELECT *, CASE WHEN printed_side = 'credit' THEN movement ELSE -movement END AS m FROM s)
 SELECT statement, seq, CASE WHEN printed_side IS NULL THEN 'unknown' WHEN b + m = balance THEN 'keep' WHEN b - m = balance THEN 'flip' ELSE 'unknown' END AS decision FROM t"""))
def side_repair(spark, d):
    return evidence.side_by_chain(rows_of(spark, d)).select("statement", "seq", "decision")


@query(with_base("SELECT a.statement, a.page, a.row_no, a.movement AS read, b.derived FROM srows a JOIN chain b USING (statement, page, row_no)"))
def raw_and_derived(spark, d):
    return evidence.raw_and_derived(rows_of(spark, d), chained(spark, d))


@query(with_base(""", k AS (SELECT *, row_number() OVER (PARTITION BY statement, page ORDER BY row_no) AS k, count(*) OVER (PARTITION BY statement, page) AS n FROM srows WHERE balance IS NOT NULL),
 o AS (SELECT statement, page, row_no, row_number() OVER (PARTITION BY statement, page ORDER BY row_no) AS k, count(*) OVER (PARTITION BY statement, page) AS n, CASE WHEN row_no % 4 = 0 THEN NULL ELSE 'second ' || row_no END AS new FROM srows WHERE balance IS NOT NULL AND NOT (page % 3 = 0 AND row_no = 2)),
 j AS (SELECT k.statement, k.page, k.row_no, o.new FROM k JOIN o USING (statement, page, k, n))
 SELECT s.statement, s.seq, coalesce(j.new, s.description) AS description, CASE WHEN j.new IS NOT NULL THEN s.description END AS old_description FROM srows s LEFT JOIN j USING (statement, page, row_no)"""))
def merged_descriptions(spark, d):
    rows = rows_of(spark, d)
    side = rows.where("balance IS NOT NULL AND NOT (page % 3 = 0 AND row_no = 2)").select("statement", "page", "row_no", F.when(F.col("row_no") % 4 == 0, " ").otherwise(F.concat(F.lit("second "), "row_no")).alias("description"))
    return evidence.merge_descriptions(rows, side).select("statement", "seq", "description", "old_description")


_TWO = ", b AS (SELECT *, CASE WHEN seq % 6 = 1 THEN movement + 1 WHEN seq % 6 = 2 THEN NULL ELSE movement END::DECIMAL(18,2) AS m2 FROM srows WHERE seq % 9 <> 0)"


def second_reader(spark, d):
    s = F.col("seq") % 6
    return rows_of(spark, d).where("seq % 9 <> 0").withColumn("movement", F.when(s == 1, F.col("movement") + 1).when(s == 2, None).otherwise(F.col("movement")).cast("decimal(18,2)"))


@query(with_base(_TWO + """, x AS (SELECT DISTINCT statement, page, movement AS m, balance AS v FROM srows WHERE movement IS NOT NULL AND balance IS NOT NULL), y AS (SELECT DISTINCT statement, page, m2 AS m, balance AS v FROM b WHERE m2 IS NOT NULL AND balance IS NOT NULL),
 z AS (SELECT statement, page, 1 AS a, 0 AS o, (EXISTS (SELECT 1 FROM y WHERE y.statement = x.statement AND y.page = x.page AND y.m = x.m AND y.v = x.v))::INT AS s FROM x UNION ALL SELECT statement, page, 0, 1, 0 FROM y)
 SELECT statement, page, sum(a)::BIGINT AS n_one, sum(o)::BIGINT AS n_other, sum(s)::BIGINT AS shared FROM z GROUP BY ALL"""))
def pair_overlap(spark, d):
    return evidence.pair_overlap(rows_of(spark, d), second_reader(spark, d))


@query(with_base(_TWO + """, j AS (SELECT a.date AS d1, b.date AS d2, a.movement AS m1, b.m2, a.balance AS b1, b.balance AS b2 FROM srows a LEFT JOIN b USING (statement, page, row_no)),
 l AS (SELECT 'date' AS cell, d1 AS x, d2 AS y FROM j UNION ALL SELECT 'movement', m1::VARCHAR, m2::VARCHAR FROM j UNION ALL SELECT 'balance', b1::VARCHAR, b2::VARCHAR FROM j)
 SELECT cell, CASE WHEN y IS NULL THEN 'absent' WHEN x IS NULL THEN 'unread' WHEN x = y THEN 'agree' ELSE 'differ' END AS result, count(*) AS n FROM l GROUP BY ALL"""))
def cell_compare(spark, d):
    return evidence.cell_compare(rows_of(spark, d), second_reader(spark, d))


@query(with_base("SELECT statement, seq FROM srows WHERE (statement + page) % 5 <> 0"))
def pack_exclusion(spark, d):
    rows = rows_of(spark, d)
    return evidence.without_pages(rows, rows.where("(statement + page) % 5 = 0")).select("statement", "seq")


@query(with_base("SELECT count(*) AS n, count(*) = 0 AS passed FROM (SELECT statement, page FROM srows WHERE page % 2 = 0 INTERSECT SELECT statement, page FROM srows WHERE page % 4 = 2)"))
def gate_overlap(spark, d):
    rows = rows_of(spark, d)
    return evidence.overlap(rows.where("page % 2 = 0"), rows.where("page % 4 = 2"))


@query(with_base(_TWO + " SELECT b.statement, b.page, b.row_no, b.m2 AS stored, a.movement AS parsed, b.page % 3 = 0 AS justified FROM b JOIN srows a USING (statement, page, row_no) WHERE b.m2 IS DISTINCT FROM a.movement"))
def provenance(spark, d):
    rows = rows_of(spark, d)
    return evidence.provenance(second_reader(spark, d), rows, rows.where("page % 3 = 0"))


# pages


@query(with_base("SELECT statement, page, own_debits, (debits - before_debits)::DECIMAL(18,2) AS printed_debits, own_credits, (credits - before_credits)::DECIMAL(18,2) AS printed_credits, delta_check = 'ok' AS same FROM vd WHERE delta_check <> 'unchecked'"))
def derivation_cross_check(spark, d):
    return evidence.cross_check(reconciled(spark, d))


@query(with_base(""", p AS (SELECT statement, page, sum(cents) FILTER (NOT credit) AS c FROM tm GROUP BY ALL), g AS (SELECT statement, (page - 1) // 3 AS k, count(*) AS n, max(page) AS last, coalesce(sum(c), 0) AS c FROM p GROUP BY ALL HAVING count(*) = 3)
 SELECT statement, last * 2 + 1 AS pos, 'third ' || k AS label, (c * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS parts, ((c + CASE WHEN (statement + k) % 7 = 0 THEN 1 ELSE 0 END) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS total, (statement + k) % 7 <> 0 AS holds FROM g"""))
def bank_breakdown(spark, d):
    pages = statements.true_movements(statements.events(spark, d)).groupBy("statement", "page").agg(F.coalesce(F.sum(F.when(~F.col("credit"), F.col("cents"))), F.lit(0)).alias("c"))
    third = F.floor((F.col("page") - 1) / 3)
    totals = pages.groupBy("statement", third.alias("k")).agg(F.count("*").alias("n"), F.max("page").alias("last"), F.sum("c").alias("c")).where("n = 3")
    wrong = F.when((F.col("statement") + F.col("k")) % 7 == 0, 1).otherwise(0)
    lines = pages.select("statement", (F.col("page") * 2).alias("pos"), F.lit(None).cast("string").alias("label"), statements.money(F.col("c")).alias("amount"))
    sums = totals.select("statement", (F.col("last") * 2 + 1).alias("pos"), F.concat(F.lit("third "), F.col("k").cast("string")).alias("label"), statements.money(F.col("c") + wrong).alias("amount"))
    return evidence.breakdown(lines.unionByName(sums))


@query(with_base("SELECT statement, page, verdict, was FROM (SELECT statement, page, verdict, lag(verdict) OVER (PARTITION BY statement ORDER BY page) AS was FROM vd) WHERE verdict IS DISTINCT FROM was"))
def verdict_changes(spark, d):
    return evidence.changes(reconciled(spark, d).select("statement", "page", "verdict"), "statement", ["page"], "verdict")


@query(with_base("SELECT statement, page, CASE WHEN row_number() OVER (PARTITION BY statement ORDER BY page) = 1 AND page > 1 AND verdict <> 'absent' THEN 'unchecked' ELSE verdict END AS verdict FROM vd WHERE page >= 3"))
def partial_run_verdicts(spark, d):
    return evidence.first_page_unchecked(reconciled(spark, d).where("page >= 3")).select("statement", "page", "verdict")


@query(with_base("SELECT statement, page, CASE WHEN EXISTS (SELECT 1 FROM chain c WHERE c.statement = vd.statement AND c.page = vd.page AND c.seq % 12 <= 9 AND vd.page % 5 <> 0) THEN verdict WHEN page % 10 = 0 THEN 'cover' ELSE 'empty' END AS label FROM vd"))
def page_labels(spark, d):
    rows = chained(spark, d).where("seq % 12 <= 9 AND page % 5 <> 0")
    pages = reconciled(spark, d)
    return evidence.verdict_label(pages, rows, pages.where("page % 10 = 0").select("statement", "page", F.lit("cover").alias("kind")))


@query(with_base(""", p AS (SELECT statement, page, verdict = 'ok' AS free FROM vd), w AS (SELECT statement, page, sum(free::INT) OVER x AS free_pages, count(*) OVER x AS n, max(page) OVER x AS last FROM p WINDOW x AS (PARTITION BY statement ORDER BY page ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
 SELECT statement, page AS from_page, free_pages::BIGINT AS free_pages FROM w WHERE n = 3 AND last - page = 2 QUALIFY row_number() OVER (PARTITION BY statement ORDER BY free_pages DESC, page) = 1"""))
def window_price(spark, d):
    return evidence.window_price(reconciled(spark, d).select("statement", "page", (F.col("verdict") == "ok").alias("free")), 3)


@query(with_base(""", c AS (SELECT statement, max((verdict = 'mismatch')::INT) AS mismatch, max(coalesce(jump, false)::INT) AS gap FROM vd GROUP BY 1), r AS (SELECT statement, max((NOT ok)::INT) AS broken FROM chain GROUP BY 1)
 SELECT statement, mismatch + gap + broken = 0 AS allowed, concat_ws(',', CASE WHEN broken = 1 THEN 'broken' END, CASE WHEN gap = 1 THEN 'gap' END, CASE WHEN mismatch = 1 THEN 'mismatch' END) AS reasons FROM c JOIN r USING (statement)"""))
def close_authority(spark, d):
    pages = reconciled(spark, d).select("statement", "verdict", "jump", F.lit(True).alias("ok"))
    rows = chained(spark, d).select("statement", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("jump"), "ok")
    return evidence.flags(pages.unionByName(rows), {"mismatch": F.col("verdict") == "mismatch", "gap": F.col("jump"), "broken": ~F.col("ok")})


@query(with_base("SELECT question, count(DISTINCT arm) AS runs, bool_and(passed) AS always, bool_or(passed) AS ever FROM (SELECT statement AS question, seq % 3 AS arm, ok AS passed FROM chain) GROUP BY 1 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT seq % 3) FROM chain)"))
def arm_stability(spark, d):
    return evidence.stability(chained(spark, d).select(F.col("statement").alias("question"), (F.col("seq") % 3).alias("arm"), F.col("ok").alias("passed")))

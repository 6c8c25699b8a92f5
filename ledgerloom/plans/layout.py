"""Queries over scanned pages: their order, and rows from the places of words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions.visual import logical_order
from ledgerloom.operators import order
from ledgerloom.operators.chain import CHAIN_SQL
from ledgerloom.plans.registry import query, with_base
from ledgerloom.sources import boxes, statements

# pages in the order of a file


def scanned(spark, d):
    """Pages and rows of statements as they lie in a file.

    Of every four statements three have neighbouring sheets swapped, and one of these a sheet far from its place. Some
    statements have a sheet scanned twice, others a misread total; a third of the printed numbers isn't read.
    """
    s, p = F.col("statement"), F.col("page")
    pos = F.when(s % 4 == 0, p).when(p % 5 == 2, p + 1).when(p % 5 == 3, p - 1).otherwise(p) * 10
    pos = F.when((s % 4 == 3) & (p == 6), 15).otherwise(pos).cast("int")
    ev = statements.events(spark, d)
    misread = (s % 6 == 5) & (p == 4) & F.col("credits").isNotNull()
    twice = lambda df, pos: df.withColumn("pos", F.explode(F.when((s % 9 == 4) & (p == 3), F.array(pos, F.lit(1005))).otherwise(F.array(pos))))
    read = statements.statement_footers(ev).withColumns({"credits": F.when(misread, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("credits")), "number": F.when((s + p) % 3 != 0, p)})
    return twice(read, pos).select("statement", "page", "pos", "debits", "credits", "number"), twice(statements.statement_rows(ev), pos)


def renamed(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[0]], sql)


#: The candidate, its longest run by a fold over each statement, and rows chained in its order.
ORDER_SQL = """, fp AS (SELECT statement, page, CASE WHEN statement % 4 = 3 AND page = 6 THEN 15 ELSE 10 * CASE WHEN statement % 4 = 0 THEN page WHEN page % 5 = 2 THEN page + 1 WHEN page % 5 = 3 THEN page - 1 ELSE page END END AS pos FROM sfoot),
 s0 AS (SELECT statement, page, pos, debits, CASE WHEN statement % 6 = 5 AND page = 4 AND credits IS NOT NULL THEN 0.01 ELSE credits END::DECIMAL(18,2) AS credits, CASE WHEN (statement + page) % 3 <> 0 THEN page END AS number FROM sfoot JOIN fp USING (statement, page)),
 s1 AS (SELECT * FROM s0 UNION ALL SELECT statement, page, 1005, debits, credits, number FROM s0 WHERE statement % 9 = 4 AND page = 3),
 s2 AS (SELECT *, debits IS NULL OR credits IS NULL AS unplaced, row_number() OVER (PARTITION BY statement ORDER BY pos) AS file_place FROM s1),
 s3 AS (SELECT *, row_number() OVER w AS rk, credits < lag(credits) OVER w AS conflict, count(*) OVER (PARTITION BY statement, debits, credits) > 1 AS duplicate FROM s2 WHERE NOT unplaced WINDOW w AS (PARTITION BY statement ORDER BY debits, credits, pos)),
 s4 AS (SELECT s2.*, rk, coalesce(conflict, false) AS conflict, coalesce(duplicate, false) AS duplicate FROM s2 LEFT JOIN s3 USING (statement, pos)),
 s5 AS (SELECT *, coalesce((SELECT x.rk FROM s4 x WHERE x.statement = s4.statement AND x.pos <= s4.pos AND x.rk IS NOT NULL ORDER BY x.pos DESC LIMIT 1), 0) AS behind FROM s4),
 s6 AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY behind, pos) AS place FROM s5),
 sq AS (SELECT statement, list(file_place ORDER BY place) AS s FROM s6 GROUP BY 1),
 fold(statement, s, i, tails, lens) AS (SELECT statement, s, 0, []::BIGINT[], []::BIGINT[] FROM sq UNION ALL
  SELECT statement, s, i + 1, list_concat(list_concat(tails[:j], [s[i + 1]]), tails[j + 2:]), list_append(lens, j + 1) FROM (SELECT *, len(list_filter(tails, lambda x: x < s[i + 1])) AS j FROM fold WHERE i < len(s))),
 runs AS (SELECT statement, s, lens FROM fold WHERE i = len(s)),
 back(statement, s, lens, spot, need) AS (SELECT statement, s, lens, list_max(list_filter(range(1, len(s) + 1), lambda i: lens[i] = list_max(lens))), list_max(lens) - 1 FROM runs UNION ALL
  SELECT statement, s, lens, list_max(list_filter(range(1, spot), lambda i: lens[i] = need)), need - 1 FROM back WHERE need > 0),
 s7 AS (SELECT s6.*, spot IS NULL AS moved FROM s6 LEFT JOIN back ON back.statement = s6.statement AND back.spot = s6.place),
 osrows AS (SELECT r.statement, row_number() OVER (PARTITION BY r.statement ORDER BY s7.place, r.row_no) AS seq, s7.place AS page, r.row_no, r.event_id, r.date, r.description, r.movement, r.balance, r.printed_side FROM s7 JOIN srows r ON r.statement = s7.statement AND r.page = s7.page),
""" + renamed(CHAIN_SQL.strip(), {n: "o" + n for n in ("ch0", "ch1", "ch2", "chain", "srows")}) + """,
 ow AS (SELECT statement, page AS place, coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0)::DECIMAL(18,2) AS od, coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0)::DECIMAL(18,2) AS oc FROM ochain GROUP BY ALL),
 s8 AS (SELECT s7.*, od, oc, lag(debits) OVER w AS bd, lag(credits) OVER w AS bc, lag(number) OVER w AS bn, lead(number) OVER w AS an FROM s7 LEFT JOIN ow USING (statement, place) WINDOW w AS (PARTITION BY statement ORDER BY place)),
 s9 AS (SELECT *, CASE WHEN place = 1 THEN NULL WHEN debits - bd = od AND credits - bc = oc THEN 'adjacent' WHEN number > bn + 1 THEN 'gap' WHEN debits - bd IS NULL OR credits - bc IS NULL OR od IS NULL THEN 'undecided' ELSE 'mismatch' END AS relation FROM s8),
 sa AS (SELECT *, coalesce(relation = 'adjacent', false) OR coalesce(lead(relation) OVER (PARTITION BY statement ORDER BY place) = 'adjacent', false) OR (number IS NOT NULL AND (bn IS NOT NULL OR an IS NOT NULL) AND coalesce(bn < number, true) AND coalesce(number < an, true)) AS witness FROM s9),
 sd AS (SELECT statement, count(*) AS pages, count(*) FILTER (unplaced) AS unplaced, count(*) FILTER (moved) AS moved, CASE WHEN bool_or(conflict) THEN 'conflict' WHEN bool_or(duplicate) THEN 'duplicate' WHEN bool_or(moved AND NOT witness) THEN 'lone' END AS reason, coalesce(list(pos ORDER BY place) FILTER (moved AND NOT witness), []) AS l FROM sa GROUP BY 1)
"""


def recursive(sql: str) -> str:
    return with_base(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(ORDER_SQL + "SELECT statement, pages, unplaced, moved, moved > 0 AND reason IS NULL AS applied, reason, CASE WHEN reason = 'lone' THEN array_to_string(l[:5], ',') ELSE '' END AS lone FROM sd"))
def page_order_decision(spark, d):
    decided, _ = order.decide_order(*scanned(spark, d))
    return decided.withColumn("lone", F.array_join("lone", ","))


@query(recursive(ORDER_SQL + "SELECT statement, pos::INT AS pos, place::INT AS place, number, relation, sa.moved, witness, (CASE WHEN sd.moved > 0 AND reason IS NULL THEN place ELSE file_place END)::INT AS \"order\" FROM sa JOIN sd USING (statement)"))
def page_order(spark, d):
    _, pages = order.decide_order(*scanned(spark, d))
    return pages


# rows from the places of words

LAYOUT = boxes.Layout(heading_prefixes=("Page total",), headings=frozenset({"Account holder"}))


def page_words(spark, d):
    """The words of the statements' pages with their places.

    Each row has a line of a date, a label, debit, credit and balance, whose words drift down by 1.4; of every seventh row
    the balance drifts on and falls off the line. Some rows have a line of text above, some one or two lines of notes below.
    """
    rows = statements.statement_rows(statements.events(spark, d)).withColumn("e", F.coalesce("event_id", F.col("statement") + F.col("page")))
    y, e = F.col("row_no") * F.lit(40.0) + 20, F.col("e")
    amount = lambda side: F.when(F.col("movement").isNotNull(), F.format_number(F.when(F.coalesce("printed_side", F.lit("debit")) == side, F.col("movement")).otherwise(0), 2))
    word = lambda top, x, text: F.struct(top.cast("double").alias("top"), F.lit(float(x)).alias("x"), text.alias("text"))
    label = lambda i: F.get(F.split("description", " "), F.lit(i))
    some = [
        word(y, 40, F.translate("date", "-", "/")), word(y + 1.4, 110, label(0)), word(y + 2.8, 150, label(1)), word(y, 190, label(2)),
        word(y + 1.4, 320, amount("debit")), word(y + 2.8, 400, amount("credit")), word(y + F.when(e % 7 == 0, 4.2).otherwise(1.4), 480, F.format_number("balance", 2)),
        word(y - 12, 120, F.when(e % 3 == 0, F.concat(F.lit("To-"), e.cast("string")))), word(y - 12, 170, F.when(e % 6 == 0, "branch")),
        word(y + 12, 110, F.when(e % 4 == 1, "Notes:")), word(y + 12, 160, F.when(e % 4 == 1, F.concat(F.lit("n"), e.cast("string")))), word(y + 18, 110, F.when(e % 8 == 1, "Time:")), word(y + 18, 150, F.when(e % 8 == 1, "12:00")),
    ]
    heads = rows.select("statement", "page").distinct()
    top = [word(F.lit(1.0), 30, F.lit("Statement")), word(F.lit(1.0), 90, F.lit("of")), word(F.lit(5.5), 110, F.lit("Account")), word(F.lit(6.5), 150, F.lit("holder")), word(F.lit(470.0), 110, F.lit("Page")), word(F.lit(470.0), 150, F.lit("total")), word(F.lit(480.0), 110, F.when(F.col("page") % 2 == 0, "Notes:")), word(F.lit(480.0), 150, F.when(F.col("page") % 2 == 0, "overleaf")), word(F.lit(490.0), 110, F.lit("lost"))]
    out = rows.select("statement", "page", F.explode(F.array(*some)).alias("w")).unionByName(heads.select("statement", "page", F.explode(F.array(*top)).alias("w")))
    return out.select("statement", "page", "w.*").where("text IS NOT NULL")


_CELL = "CASE WHEN movement IS NOT NULL THEN format('{{:,.2f}}', CASE WHEN coalesce(printed_side, 'debit') = '{}' THEN movement ELSE 0 END::DOUBLE) END"
WORDS_SQL = """, rw AS (SELECT *, coalesce(event_id, statement + page) AS e, row_no * 40.0::DOUBLE + 20 AS y FROM srows),
 wd AS (SELECT statement, page, w.top, w.x, w.text FROM (SELECT statement, page, unnest([{top: y, x: 40.0::DOUBLE, text: replace(date, '-', '/')}, {top: y + 1.4::DOUBLE, x: 110, text: split_part(description, ' ', 1)}, {top: y + 2.8::DOUBLE, x: 150, text: split_part(description, ' ', 2)}, {top: y, x: 190, text: split_part(description, ' ', 3)},
   {top: y + 1.4::DOUBLE, x: 320, text: """ + _CELL.format("debit") + """}, {top: y + 2.8::DOUBLE, x: 400, text: """ + _CELL.format("credit") + """}, {top: y + CASE WHEN e % 7 = 0 THEN 4.2 ELSE 1.4 END::DOUBLE, x: 480, text: CASE WHEN balance IS NOT NULL THEN format('{:,.2f}', balance::DOUBLE) END},
   {top: y - 12, x: 120, text: CASE WHEN e % 3 = 0 THEN 'To-' || e END}, {top: y - 12, x: 170, text: CASE WHEN e % 6 = 0 THEN 'branch' END}, {top: y + 12, x: 110, text: CASE WHEN e % 4 = 1 THEN 'Notes:' END}, {top: y + 12, x: 160, text: CASE WHEN e % 4 = 1 THEN 'n' || e END}, {top: y + 18, x: 110, text: CASE WHEN e % 8 = 1 THEN 'Time:' END}, {top: y + 18, x: 150, text: CASE WHEN e % 8 = 1 THEN '12:00' END}]) AS w FROM rw
  UNION ALL SELECT statement, page, unnest([{top: 1.0::DOUBLE, x: 30.0::DOUBLE, text: 'Statement'}, {top: 1, x: 90, text: 'of'}, {top: 5.5, x: 110, text: 'Account'}, {top: 6.5, x: 150, text: 'holder'}, {top: 470, x: 110, text: 'Page'}, {top: 470, x: 150, text: 'total'}, {top: 480, x: 110, text: CASE WHEN page % 2 = 0 THEN 'Notes:' END}, {top: 480, x: 150, text: CASE WHEN page % 2 = 0 THEN 'overleaf' END}, {top: 490, x: 110, text: 'lost'}]) FROM (SELECT DISTINCT statement, page FROM srows)) WHERE w.text <> ''),
 an AS (SELECT statement, page, list_reduce(list_transform(list_sort(list(DISTINCT top)), lambda t: [t]), lambda a, t: CASE WHEN t[1] - a[len(a)] > 3 THEN list_concat(a, t) ELSE a END) AS a FROM wd GROUP BY ALL),
 ln AS (SELECT statement, page, line, list({x: x, text: text} ORDER BY x, top, text) AS w FROM (SELECT wd.*, len(list_filter(a, lambda t: t <= wd.top)) AS line FROM wd JOIN an USING (statement, page)) GROUP BY ALL),
 l1 AS (SELECT statement, page, line, list_transform(list_filter(w, lambda v: v.x > 300 AND regexp_full_match(v.text, '-?[0-9,]+\\.[0-9]{2}')), lambda v: v.text) AS cells, list_filter(w, lambda v: v.x < 100 AND regexp_full_match(v.text, '[0-9]{4}/[0-9]{2}/[0-9]{2}'))[1].text AS day,
   list_transform(list_filter(w, lambda v: v.x <= 300 AND NOT (v.x < 100 AND regexp_full_match(v.text, '[0-9]{4}/[0-9]{2}/[0-9]{2}'))), lambda v: v.text) AS said, trim(array_to_string(list_transform(w, lambda v: v.text), ' ')) AS text FROM ln),
 l2 AS (SELECT *, coalesce(sum((len(cells) >= 3)::INT) OVER (PARTITION BY statement ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM l1),
 l3 AS (SELECT *, CASE WHEN len(cells) >= 3 THEN 'row' WHEN text = '' OR regexp_matches(text, '^(Ref\\.|Date|Statement|Page total)') OR text = 'Account holder' THEN 'skipped' WHEN regexp_matches(text, '^(Time:|Notes:)') AND above > 0 THEN 'note' ELSE 'text' END AS kind FROM l2)
"""


@query(with_base(WORDS_SQL + "SELECT statement, page, line::INT AS line, kind, text FROM l3"))
def word_lines(spark, d):
    return boxes.printed_lines(page_words(spark, d), LAYOUT).select("statement", "page", "line", "kind", "text")


@query(with_base(WORDS_SQL + """, pd_ AS (SELECT statement, page, above + 1 AS row_no, string_agg(text, ' ' ORDER BY line) AS pending FROM l3 WHERE kind = 'text' GROUP BY ALL), nt AS (SELECT statement, above AS row_no, string_agg(text, ' ' ORDER BY page, line) AS notes FROM l3 WHERE kind = 'note' GROUP BY ALL),
 r AS (SELECT statement, page, above + 1 AS row_no, cells, day, array_to_string(said, ' ') AS said FROM l3 WHERE kind = 'row'),
 v AS (SELECT *, list_transform(cells, lambda c: replace(c, ',', '')::DECIMAL(18,2)) AS n FROM r)
 SELECT statement, page, row_no::INT AS row_no, day AS date, CASE WHEN n[2] <> 0 THEN n[2] ELSE n[1] END AS movement, n[3] AS balance, nullif(trim(concat_ws(' ', concat_ws(' ', pending, said), notes)), '') AS description, CASE WHEN n[2] <> 0 THEN cells[2] ELSE cells[1] END AS raw_movement, cells[3] AS raw_balance FROM v LEFT JOIN pd_ USING (statement, page, row_no) LEFT JOIN nt USING (statement, row_no)"""))
def word_rows(spark, d):
    return boxes.rows_of_words(page_words(spark, d), LAYOUT)


#: Isolated presentation forms of 26 letters of the Arabic script, for the letters a to z (Unicode block Presentation Forms-B).
FORMS = "".join(map(chr, (0xFE8D, 0xFE8F, 0xFE95, 0xFE99, 0xFE9D, 0xFEA1, 0xFEA5, 0xFEA9, 0xFEAB, 0xFEAD, 0xFEAF, 0xFEB1, 0xFEB5, 0xFEB9, 0xFEBD, 0xFEC1, 0xFEC5, 0xFEC9, 0xFECD, 0xFED1, 0xFED5, 0xFED9, 0xFEDD, 0xFEE1, 0xFEE5, 0xFEE9)))
LATIN, LAM_ALEF = "abcdefghijklmnopqrstuvwxyz", "ﻹا"


@query(with_base(f""", t AS (SELECT statement, seq, translate(lower(description), '{LATIN}', '{unicodedata.normalize("NFKC", FORMS)}') || CASE WHEN seq % 3 = 0 THEN ' {unicodedata.normalize("NFKC", LAM_ALEF)}' ELSE '' END || CASE WHEN seq % 4 = 0 THEN ' No. 7 (b)' ELSE '' END AS t FROM srows)
 SELECT statement, seq, array_to_string(list_transform(regexp_extract_all(t, '[\\x{{0600}}-\\x{{06FF}} ]+|[^\\x{{0600}}-\\x{{06FF}} ]+'), lambda x: CASE WHEN regexp_matches(x, '^[\\x{{0600}}-\\x{{06FF}} ]') THEN replace(reverse(x), 'اإل', 'الإ') ELSE x END), '') AS text FROM t"""))
def visual_order(spark, d):
    rows = statements.statement_rows(statements.events(spark, d))
    seen = F.concat(F.translate(F.lower("description"), LATIN, FORMS), F.when(F.col("seq") % 3 == 0, " " + LAM_ALEF).otherwise(""), F.when(F.col("seq") % 4 == 0, " No. 7 (b)").otherwise(""))
    return rows.select("statement", "seq", logical_order(seen).alias("text"))

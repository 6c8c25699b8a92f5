"""The library's queries over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import chain, footers, tools
from ledgerloom.operators.chain import CHAIN_SQL
from ledgerloom.sources import statements
from ledgerloom.sources.statements import BASE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL over the common tables."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def with_base(sql: str) -> str:
    return "WITH " + BASE_SQL.strip() + ",\n" + CHAIN_SQL.strip() + ",\n" + ISO_SQL.strip() + (",\n" + sql.strip()[1:].strip() if sql.strip().startswith(",") else "\n" + sql.strip())


#: Movements with iso dates (mv) and page totals with footers (pf) in DuckDB.
ISO_SQL = """
ci AS (SELECT *, CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(date AS DATE) IS NOT NULL THEN date END AS iso FROM chain),
mv AS (SELECT * FROM ci WHERE NOT opening),
pt AS (SELECT statement, page, coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0)::DECIMAL(18,2) AS own_debits, coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0)::DECIMAL(18,2) AS own_credits, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS own_balance, count(*) FILTER (NOT opening AND side = '' AND derived IS NOT NULL) AS undecided FROM chain GROUP BY ALL),
pf AS (SELECT pt.*, f.debits, f.credits, f.balance, lag(page) OVER w AS before_page, lag(f.debits) OVER w AS before_debits, lag(f.credits) OVER w AS before_credits, lag(f.balance) OVER w AS before_balance FROM pt LEFT JOIN sfoot f USING (statement, page) WINDOW w AS (PARTITION BY statement ORDER BY page)),
pd AS (SELECT *, coalesce(page - before_page <> 1, false) AS jump, CASE WHEN debits - before_debits IS NULL OR credits - before_credits IS NULL THEN 'unchecked' WHEN debits - before_debits = own_debits AND credits - before_credits = own_credits THEN 'ok' ELSE 'mismatch' END AS delta_check FROM pf),
pc AS (SELECT *, sum(own_debits) OVER w AS sum_debits, sum(own_credits) OVER w AS sum_credits FROM pd WINDOW w AS (PARTITION BY statement ORDER BY page ROWS UNBOUNDED PRECEDING)),
pc2 AS (SELECT *, bool_or(coalesce(debits <> sum_debits OR credits <> sum_credits, false) OR coalesce(page - before_page <> 1, page <> 1)) OVER (PARTITION BY statement ORDER BY page ROWS UNBOUNDED PRECEDING) AS broken FROM pc),
pv AS (SELECT *, CASE WHEN debits IS NULL THEN 'unchecked' WHEN broken THEN 'mismatch' ELSE 'ok' END AS cum_check FROM pc2),
vd AS (SELECT *, CASE WHEN debits IS NULL THEN 'absent' WHEN jump AND delta_check <> 'unchecked' THEN 'gap' WHEN delta_check <> 'unchecked' THEN delta_check WHEN cum_check = 'mismatch' THEN 'unchecked' ELSE cum_check END AS verdict FROM pv)
"""


def chained(spark: SparkSession, d: str) -> DataFrame:
    return chain.derive(statements.statement_rows(statements.events(spark, d)))


def moved(spark: SparkSession, d: str) -> DataFrame:
    return tools.movements(chained(spark, d))


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    both = footers.with_footers(footers.page_totals(chained(spark, d)), statements.statement_footers(statements.events(spark, d)))
    return footers.verdict(footers.delta(footers.cumulative(both)))


# the chain


@query(with_base("SELECT statement, seq, page, derived, side, ok, opening, boundary, scale_fixed FROM chain"))
def chain_derive(spark, d):
    return chained(spark, d).select("statement", "seq", "page", "derived", "side", "ok", "opening", "boundary", "scale_fixed")


@query(with_base("""SELECT statement, count(*) AS n_rows, coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0)::DECIMAL(18,2) AS debits, coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0)::DECIMAL(18,2) AS credits,
 count(*) FILTER (NOT ok) AS suspects, count(*) FILTER (boundary = 'anchor') AS anchors, count(*) FILTER (scale_fixed) AS scale_fixed FROM chain GROUP BY statement"""))
def statement_totals(spark, d):
    side = lambda s: F.coalesce(F.sum(F.when(~F.col("opening") & (F.col("side") == s), F.col("derived"))), F.lit(0)).cast("decimal(18,2)")
    return chained(spark, d).groupBy("statement").agg(F.count("*").alias("n_rows"), side("debit").alias("debits"), side("credit").alias("credits"), F.count_if(~F.col("ok")).alias("suspects"), F.count_if(F.col("boundary") == "anchor").alias("anchors"), F.count_if("scale_fixed").alias("scale_fixed"))


# the closed questions


@query(with_base("SELECT statement, coalesce(sum(derived), 0)::DECIMAL(18,2) AS total, count(*) AS n, count(*) FILTER (derived IS NULL) AS no_amount, count(*) FILTER (iso IS NULL) AS undated, array_to_string(list_slice(list_sort(list(seq)), 1, 3), ',') AS examples FROM mv WHERE side = 'debit' GROUP BY statement"))
def sum_movements(spark, d):
    return tools.sum_movements(tools.select(moved(spark, d), side="debit"))


@query(with_base("SELECT statement, side, count(*) AS n FROM mv WHERE iso BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL"))
def count_movements(spark, d):
    return tools.select(moved(spark, d), since="2024-01-05", until="2024-01-20").groupBy("statement", "side").agg(F.count("*").alias("n"))


@query(with_base("SELECT statement, max(balance) AS highest, arg_max(seq, (balance, -seq)) FILTER (balance IS NOT NULL) AS highest_seq, min(balance) AS lowest, arg_min(seq, (balance, seq)) FILTER (balance IS NOT NULL) AS lowest_seq, count(*) FILTER (balance IS NULL) AS unread FROM chain GROUP BY statement"))
def balance_extremes(spark, d):
    return tools.balance_extremes(chained(spark, d))


@query(with_base("SELECT statement, arg_max(balance, seq) AS closing, max(seq) AS seq FROM chain WHERE balance IS NOT NULL GROUP BY statement"))
def closing_balance(spark, d):
    return tools.closing_balance(chained(spark, d))


@query(with_base("""SELECT statement, page, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS first_balance, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS last_balance,
 coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0)::DECIMAL(18,2) AS debits, coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0)::DECIMAL(18,2) AS credits,
 count(*) FILTER (NOT opening AND side = '') AS undecided, coalesce(sum(derived) FILTER (NOT opening AND side = ''), 0)::DECIMAL(18,2) AS undecided_sum, count(*) AS rows FROM chain GROUP BY ALL"""))
def page_summary(spark, d):
    return tools.page_summary(chained(spark, d))


@query(with_base("SELECT statement, page, seq, description, derived, side, balance, greatest(c - 8, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY statement, page ORDER BY seq) AS n, count(*) OVER (PARTITION BY statement, page) AS c FROM chain) WHERE n <= 8"))
def page_rows(spark, d):
    return tools.page_rows(chained(spark, d), limit=8)


@query(with_base("SELECT statement, n::INT AS n, seq, description, derived, side, found FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY seq) AS n, count(*) OVER (PARTITION BY statement) AS found FROM mv WHERE contains(lower(description), 'transfer')) WHERE n <= 15"))
def search_rows(spark, d):
    return tools.search_rows(moved(spark, d), "Transfer")


@query(with_base("""SELECT statement, min(iso) AS first_day, arg_min(seq, (iso, seq)) FILTER (iso IS NOT NULL) AS first_seq, max(iso) AS last_day, arg_max(seq, (iso, -seq)) FILTER (iso IS NOT NULL) AS last_seq, count(*) FILTER (iso IS NULL) AS undated,
 (date_diff('day', min(iso)::DATE, max(iso)::DATE) + 1)::BIGINT AS days, round((date_diff('day', min(iso)::DATE, max(iso)::DATE) + 1) / 7.0::DOUBLE, 2)::DECIMAL(10,2) AS weeks FROM mv GROUP BY statement"""))
def statement_period(spark, d):
    return tools.statement_period(moved(spark, d))


@query(with_base("SELECT statement, iso, seq, balance FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY iso DESC, seq DESC) AS r FROM ci WHERE iso <= '2024-01-15' AND balance IS NOT NULL) WHERE r = 1"))
def balance_on(spark, d):
    return tools.balance_on(chained(spark, d), "2024-01-15")


@query(with_base(""", q AS (SELECT DISTINCT statement, unnest(['2024-01-03', '2024-01-10', '2024-01-17', '2024-01-31']) AS day FROM chain),
 b AS (SELECT q.statement, q.day, c.balance, row_number() OVER (PARTITION BY q.statement, q.day ORDER BY c.iso DESC NULLS LAST, c.seq DESC) AS r FROM q LEFT JOIN ci c ON c.statement = q.statement AND c.iso <= q.day AND c.balance IS NOT NULL)
 SELECT statement, day, balance FROM b WHERE r = 1"""))
def balance_each_day(spark, d):
    rows = chained(spark, d)
    days = rows.select("statement").distinct().select("statement", F.explode(F.array(*[F.lit(x) for x in ("2024-01-03", "2024-01-10", "2024-01-17", "2024-01-31")])).alias("day"))
    return tools.balance_each_day(rows, days)


@query(with_base("SELECT statement, iso AS day, count(*) AS n, coalesce(sum(derived) FILTER (side = 'debit'), 0)::DECIMAL(18,2) AS debits, coalesce(sum(derived) FILTER (side = 'credit'), 0)::DECIMAL(18,2) AS credits, (coalesce(sum(derived) FILTER (side = 'credit'), 0) - coalesce(sum(derived) FILTER (side = 'debit'), 0))::DECIMAL(18,2) AS net FROM mv WHERE iso IS NOT NULL GROUP BY ALL"))
def group_by_date(spark, d):
    return tools.group_by_date(moved(spark, d))


@query(with_base(""", m AS (SELECT statement, count(DISTINCT iso) AS active_days, count(*) AS n, coalesce(sum(derived), 0)::DECIMAL(18,2) AS total, ((date_diff('day', min(iso)::DATE, max(iso)::DATE) + 1) * 200 + 7) // 14 AS w FROM mv WHERE iso IS NOT NULL GROUP BY statement),
 h AS (SELECT *, n * 10000 AS a, (total * 100)::BIGINT * 100 AS b FROM m)
 SELECT statement, active_days, n, total, (w * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS weeks, ((a // w + CASE WHEN 2 * (a % w) > w OR 2 * (a % w) = w AND (a // w) % 2 = 1 THEN 1 ELSE 0 END) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS per_week, ((b // w + CASE WHEN 2 * (b % w) > w OR 2 * (b % w) = w AND (b // w) % 2 = 1 THEN 1 ELSE 0 END) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS amount_per_week FROM h"""))
def movement_days(spark, d):
    return tools.movement_days(moved(spark, d))


@query(with_base("SELECT statement, page, debits, credits, balance, verdict FROM vd"))
def page_footer(spark, d):
    return reconciled(spark, d).select("statement", "page", "debits", "credits", "balance", "verdict")


# reconciliation


@query(with_base("SELECT * FROM pt"))
def page_totals(spark, d):
    return footers.page_totals(chained(spark, d))


@query(with_base("SELECT statement, page, sum_debits::DECIMAL(18,2) AS sum_debits, sum_credits::DECIMAL(18,2) AS sum_credits, cum_check FROM vd"))
def footer_cumulative(spark, d):
    return reconciled(spark, d).select("statement", "page", "sum_debits", "sum_credits", "cum_check")


@query(with_base("SELECT statement, page, jump, delta_check FROM vd"))
def footer_delta(spark, d):
    return reconciled(spark, d).select("statement", "page", "jump", "delta_check")


@query(with_base("SELECT statement, page, verdict FROM vd"))
def page_verdict(spark, d):
    return reconciled(spark, d).select("statement", "page", "verdict")


@query(with_base(""", hd AS (SELECT statement, page, lost, debits - before_debits AS sd, credits - before_credits AS sc, (own_debits * CASE WHEN lost THEN 100 ELSE 1 END)::DECIMAL(18,2) AS od, (own_credits * CASE WHEN lost THEN 100 ELSE 1 END)::DECIMAL(18,2) AS oc FROM (SELECT *, (statement + page) % 6 = 2 AS lost FROM pf))
 SELECT statement, page FROM hd WHERE NOT (sd = od AND sc = oc) AND (sd = od OR sd * 100 = od OR sd = od * 100) AND (sc = oc OR sc * 100 = oc OR sc = oc * 100)"""))
def paradox_x100(spark, d):
    totals, lost = footers.page_totals(chained(spark, d)), (F.col("statement") + F.col("page")) % 6 == 2
    totals = totals.withColumns({c: (F.col(c) * F.when(lost, 100).otherwise(1)).cast("decimal(18,2)") for c in ("own_debits", "own_credits")})  # decimal points of a page not seen
    pages = footers.with_footers(totals, statements.statement_footers(statements.events(spark, d)))
    return footers.verdict(footers.delta(footers.cumulative(pages))).where("paradox").select("statement", "page")


@query(with_base("SELECT statement, verdict, count(*) AS pages FROM vd GROUP BY ALL"))
def verdict_tally(spark, d):
    return reconciled(spark, d).groupBy("statement", "verdict").agg(F.count("*").alias("pages"))


@query(with_base("""SELECT statement, page, first_balance, last_before, (first_balance - last_before)::DECIMAL(18,2) AS crossing, boundary FROM (
 SELECT statement, page, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS first_balance, arg_min(boundary, seq) FILTER (boundary IS NOT NULL) AS boundary, lag(arg_max(balance, seq) FILTER (balance IS NOT NULL)) OVER (PARTITION BY statement ORDER BY page) AS last_before FROM chain GROUP BY statement, page) WHERE last_before IS NOT NULL"""))
def verify_anchors(spark, d):
    from pyspark.sql import Window

    b = F.col("balance").isNotNull()
    pages = chained(spark, d).groupBy("statement", "page").agg(F.min_by("balance", F.when(b, F.col("seq"))).alias("first_balance"), F.max_by("balance", F.when(b, F.col("seq"))).alias("last"), F.min_by("boundary", F.when(F.col("boundary").isNotNull(), F.col("seq"))).alias("boundary"))
    pages = pages.withColumn("last_before", F.lag("last").over(Window.partitionBy("statement").orderBy("page")))
    return pages.where("last_before IS NOT NULL").select("statement", "page", "first_balance", "last_before", (F.col("first_balance") - F.col("last_before")).cast("decimal(18,2)").alias("crossing"), "boundary")


@query(with_base("""SELECT statement, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS opening_balance, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing_balance,
 coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0)::DECIMAL(18,2) AS credits, coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0)::DECIMAL(18,2) AS debits,
 arg_min(balance, seq) FILTER (balance IS NOT NULL) + coalesce(sum(derived) FILTER (NOT opening AND side = 'credit'), 0) - coalesce(sum(derived) FILTER (NOT opening AND side = 'debit'), 0) = arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closes, count(*) FILTER (NOT ok) AS breaks FROM chain GROUP BY statement"""))
def verify_statement(spark, d):
    b, c = F.col("balance"), ~F.col("opening")
    side = lambda s: F.coalesce(F.sum(F.when(c & (F.col("side") == s), F.col("derived"))), F.lit(0)).cast("decimal(18,2)")
    out = chained(spark, d).groupBy("statement").agg(F.min_by("balance", F.when(b.isNotNull(), F.col("seq"))).alias("opening_balance"), F.max_by("balance", F.when(b.isNotNull(), F.col("seq"))).alias("closing_balance"), side("credit").alias("credits"), side("debit").alias("debits"), F.count_if(~F.col("ok")).alias("breaks"))
    return out.withColumn("closes", F.col("opening_balance") + F.col("credits") - F.col("debits") == F.col("closing_balance"))


@query(with_base("SELECT statement, (l + 1)::INT AS from_page, (page - 1)::INT AS to_page, (page - l - 1)::INT AS missing FROM (SELECT statement, page, coalesce(lag(page) OVER (PARTITION BY statement ORDER BY page), 0) AS l FROM (SELECT DISTINCT statement, page FROM chain)) WHERE page - l > 1"))
def page_number_gaps(spark, d):
    return footers.page_numbers(chained(spark, d))


@query(with_base("""SELECT statement, before_page, page, CASE WHEN debits - before_debits = own_debits AND credits - before_credits = own_credits THEN 'adjacent' WHEN coalesce(n > before_n + 1, false) THEN 'gap'
 WHEN debits - before_debits IS NULL OR credits - before_credits IS NULL THEN 'undecided' ELSE 'mismatch' END AS relation FROM (SELECT *, lag(n) OVER (PARTITION BY statement ORDER BY page) AS before_n FROM (SELECT *, CASE WHEN (statement + page) % 3 <> 0 THEN page END AS n FROM pd)) WHERE before_page IS NOT NULL"""))
def adjacency(spark, d):
    read = F.when((F.col("statement") + F.col("page")) % 3 != 0, F.col("page"))
    return footers.adjacency(reconciled(spark, d).withColumn("number", read), "number")


@query(with_base(""", x AS (SELECT *, coalesce(sum(CASE WHEN debits IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY statement ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span FROM pd),
 y AS (SELECT statement, span, min(page) AS from_page, max(page) AS to_page, count(*) AS pages, sum(own_debits) AS od, sum(own_credits) AS oc, max(debits) AS d, max(credits) AS c, count(*) FILTER (debits IS NULL) AS frameless, bool_or(jump) AS j FROM x GROUP BY ALL),
 z AS (SELECT *, coalesce(d - lag(d) OVER w = od AND c - lag(c) OVER w = oc AND NOT j, false) AS held FROM y WINDOW w AS (PARTITION BY statement ORDER BY span))
 SELECT statement, span, from_page, to_page, pages, held, CASE WHEN held THEN frameless ELSE 0 END AS gained FROM z"""))
def span_verify(spark, d):
    return footers.spans(reconciled(spark, d))


@query(with_base(""", e AS (SELECT statement, page, arg_min(balance, seq) AS b, arg_min(CASE WHEN side = 'credit' THEN derived WHEN side = 'debit' THEN -derived END, seq) AS m FROM chain WHERE balance IS NOT NULL GROUP BY ALL),
 f AS (SELECT *, first_v.printed FROM e LEFT JOIN (SELECT statement AS s2, page AS p2, arg_min(CASE WHEN printed_side = 'credit' THEN movement WHEN printed_side = 'debit' THEN -movement END, seq) FILTER (row_no > 0) AS printed FROM chain GROUP BY ALL) first_v ON s2 = statement AND p2 = page),
 g AS (SELECT pd.*, f.b - f.printed AS first_prev, (credits - before_credits - own_credits) - (debits - before_debits - own_debits) AS net FROM pd LEFT JOIN f USING (statement, page) WHERE jump)
 SELECT statement, before_page, page, (page - before_page - 1)::INT AS sheets, (debits - before_debits - own_debits)::DECIMAL(18,2) AS gap_debits, (credits - before_credits - own_credits)::DECIMAL(18,2) AS gap_credits,
  CASE WHEN net IS NULL OR first_prev - before_balance IS NULL THEN 'unproven' WHEN abs(net - (first_prev - before_balance)) <= 0.01 THEN 'proven' ELSE 'disagreed' END AS witness FROM g"""))
def gap_entries(spark, d):
    rows = chained(spark, d)
    b, signed = F.col("balance"), F.when(F.col("printed_side") == "credit", F.col("movement")).when(F.col("printed_side") == "debit", -F.col("movement"))
    edges = rows.groupBy("statement", "page").agg((F.min_by("balance", F.when(b.isNotNull(), F.col("seq"))) - F.min_by(signed, F.when((F.col("row_no") > 0) & signed.isNotNull(), F.col("seq")))).alias("first_prev"))
    return footers.gap_entries(reconciled(spark, d), edges)


@query(with_base(""", f AS (SELECT statement, CASE WHEN page % 5 = 2 THEN page + 1 WHEN page % 5 = 3 THEN page - 1 ELSE page END AS pos, debits, credits FROM sfoot WHERE debits IS NOT NULL AND credits IS NOT NULL)
 SELECT statement, pos::INT AS pos, (row_number() OVER w)::INT AS rank, coalesce(credits < lag(credits) OVER w, false) AS conflict, coalesce(credits = lag(credits) OVER w AND debits = lag(debits) OVER w, false) AS duplicate, coalesce(pos < lag(pos) OVER w, false) AS moved_back FROM f WINDOW w AS (PARTITION BY statement ORDER BY debits, credits, pos)"""))
def footer_order_conflicts(spark, d):
    return footers.order_conflicts(shuffled(spark, d), "pos")


def shuffled(spark, d):
    """Footers at file positions of which every fifth pair is swapped."""
    p = F.col("page")
    return statements.statement_footers(statements.events(spark, d)).withColumn("pos", F.when(p % 5 == 2, p + 1).when(p % 5 == 3, p - 1).otherwise(p).cast("int"))


@query()
def footer_order_lis(spark, d):
    return footers.fewest_moved(footers.order_conflicts(shuffled(spark, d), "pos"), "pos")


#: One round of repairs in DuckDB, from q{n} to q{m}: candidates as rows, the first that fits wins.
_REPAIR = """r{n} AS (SELECT *, lag(balance) OVER w AS up, lead(balance) OVER w AS down, lead(movement) OVER w AS nm, row_number() OVER w AS rn FROM q{n} WINDOW w AS (PARTITION BY statement ORDER BY seq)),
 k{n} AS (SELECT statement, seq, k, up + k * movement AS x, down, nm, balance FROM r{n}, (VALUES (-1), (1)) t(k)),
 b{n} AS (SELECT statement, seq, arg_min(x, k) AS fresh FROM k{n} WHERE abs(down - x) = nm AND down <> x AND len(x::VARCHAR) = len(balance::VARCHAR) AND hamming(x::VARCHAR, balance::VARCHAR) = 1 GROUP BY ALL),
 f{n} AS (SELECT r{n}.*, fresh FROM r{n} LEFT JOIN b{n} USING (statement, seq)),
 t{n} AS (SELECT *, fresh IS NOT NULL AND (rn - coalesce(last_value(CASE WHEN fresh IS NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY statement ORDER BY seq ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS take FROM f{n}),
 q{m} AS (SELECT statement, seq, movement, (CASE WHEN take THEN fresh ELSE balance END)::DECIMAL(18,2) AS balance, repaired OR take AS repaired FROM t{n})"""


@query(with_base(", q0 AS (SELECT statement, seq, movement, CASE WHEN seq % 17 = 8 THEN balance + CASE WHEN floor(abs(balance)) % 10 = 9 THEN -1 ELSE 1 END * CASE WHEN balance < 0 THEN -1 ELSE 1 END ELSE balance END::DECIMAL(18,2) AS balance, false AS repaired FROM chain), " + ", ".join(_REPAIR.format(n=n, m=n + 1) for n in range(3)) + " SELECT statement, seq, balance, repaired FROM q3"))
def repair_balance(spark, d):
    return footers.repair_balances(misread_balances(chained(spark, d)))


def misread_balances(rows):
    """Every seventeenth balance with its third sign from the right (the last digit before the point) one off."""
    off = F.when(F.floor(F.abs("balance")) % 10 == 9, -1).otherwise(1) * F.when(F.col("balance") < 0, -1).otherwise(1)
    return rows.withColumn("balance", F.when(F.col("seq") % 17 == 8, F.col("balance") + off).otherwise(F.col("balance")).cast("decimal(18,2)"))


# scalar functions over printed tokens made from the events


def tokens(spark, d):
    rows = statements.true_movements(statements.events(spark, d))
    i, f, k = F.floor(F.col("cents") / 100).cast("long").cast("string"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.col("event_id") % 10
    plain = F.concat(i, F.lit("."), f)
    token = F.when(k == 0, plain).when(k == 1, F.concat(i, F.lit(","), f)).when(k == 2, F.concat(F.lit("1,"), F.lpad(i, 3, "0"), F.lit("."), f)).when(k == 3, F.concat(plain, F.lit("-"))).when(k == 4, F.concat(F.lit("-"), i, F.lit(","), f)).when(k == 5, F.translate(plain, "0123456789.", "٠١٢٣٤٥٦٧٨٩٫")).when(k == 6, F.concat(F.lit("1,"), F.lpad(i, 3, "0"), f)).when(k == 7, F.lit(".,.")).when(k == 8, F.concat(F.lit("12,"), F.lpad(i, 3, "0"))).otherwise(F.concat(F.lit("SAR "), i, F.lit("."), F.substring(f, 1, 1)))
    return rows.select("event_id", "statement", "page", token.alias("token"))


TOKENS_SQL = """, tk0 AS (SELECT event_id, event_id % 10 AS k, (cents // 100)::VARCHAR AS i, lpad((cents % 100)::VARCHAR, 2, '0') AS f FROM tm),
 tk AS (SELECT event_id, i, f, k, CASE k WHEN 0 THEN i || '.' || f WHEN 1 THEN i || ',' || f WHEN 2 THEN '1,' || lpad(i, 3, '0') || '.' || f WHEN 3 THEN i || '.' || f || '-' WHEN 4 THEN '-' || i || ',' || f WHEN 5 THEN translate(i || '.' || f, '0123456789.', '٠١٢٣٤٥٦٧٨٩٫') WHEN 6 THEN '1,' || lpad(i, 3, '0') || f WHEN 7 THEN '.,.' WHEN 8 THEN '12,' || lpad(i, 3, '0') ELSE 'SAR ' || i || '.' || f[1:1] END AS token FROM tk0)
"""


@query(with_base(TOKENS_SQL + """SELECT event_id, token, (CASE k WHEN 0 THEN i || '.' || f WHEN 1 THEN i || '.' || f WHEN 2 THEN '1' || lpad(i, 3, '0') || '.' || f WHEN 3 THEN '-' || i || '.' || f WHEN 4 THEN '-' || i || '.' || f WHEN 5 THEN i || '.' || f
 WHEN 6 THEN '1' || lpad(i, 3, '0') || '.' || f WHEN 7 THEN '0' WHEN 8 THEN '12' || lpad(i, 3, '0') END)::DECIMAL(18,2) AS amount FROM tk"""))
def parse_amount(spark, d):
    return tokens(spark, d).select("event_id", "token", scalars.parse_amount(F.col("token")).alias("amount"))


@query(with_base(TOKENS_SQL + "SELECT event_id, CASE WHEN k IN (0, 2, 3, 5, 9) THEN 'dot' WHEN k IN (1, 4) THEN 'comma2' WHEN k = 6 THEN 'comma_long' WHEN k = 8 THEN 'comma3' ELSE 'none' END AS style FROM tk"))
def token_style(spark, d):
    return tokens(spark, d).select("event_id", scalars.token_style(F.col("token")).alias("style"))


@query(with_base(TOKENS_SQL + ", s AS (SELECT CASE WHEN k IN (0, 2, 3, 5, 9) THEN 'dot' WHEN k = 7 THEN 'none' ELSE 'comma' END AS era, tm.statement, tm.page FROM tk JOIN tm USING (event_id)), c AS (SELECT statement, page, count(*) FILTER (era = 'dot') AS dots, count(*) FILTER (era = 'comma') AS commas FROM s GROUP BY ALL) SELECT statement, page, dots, commas, CASE WHEN dots + commas = 0 THEN 'none' WHEN dots >= 3 * commas THEN 'dot' WHEN commas >= 3 * dots THEN 'comma' ELSE 'mixed' END AS era FROM c"))
def era_fingerprint(spark, d):
    rows = tokens(spark, d).withColumn("s", scalars.token_style(F.col("token")))
    out = rows.groupBy("statement", "page").agg(F.count_if(F.col("s") == "dot").alias("dots"), F.count_if(F.col("s").startswith("comma")).alias("commas"))
    return out.withColumn("era", F.when(F.col("dots") + F.col("commas") == 0, "none").when(F.col("dots") >= 3 * F.col("commas"), "dot").when(F.col("commas") >= 3 * F.col("dots"), "comma").otherwise("mixed"))


@query(with_base("SELECT statement, seq, iso, CASE WHEN date IS NULL THEN 'missing' WHEN iso IS NULL THEN 'implausible' ELSE 'ok' END AS status FROM ci"))
def normalize_date(spark, d):
    r = scalars.read_date(F.col("date"))
    return chained(spark, d).select("statement", "seq", F.when(r.status == "ok", r.iso).alias("iso"), r.status.alias("status"))


@query(with_base("SELECT statement, seq, CASE WHEN contains(lower(description), 'transfer received') THEN 'transfer_in' WHEN contains(lower(description), 'card payment') THEN 'card' WHEN contains(lower(description), 'fee') THEN 'fee' WHEN contains(lower(description), 'standing order') THEN 'standing_order' WHEN contains(lower(description), 'deposit') THEN 'deposit' WHEN contains(lower(description), 'brought forward') THEN 'brought_forward' ELSE 'other' END AS kind FROM chain"))
def classify_type(spark, d):
    return chained(spark, d).select("statement", "seq", scalars.transaction_kind(F.col("description"), F.col("side")).alias("kind"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS form FROM documents")
def norm_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.search_form(F.col("text")).alias("form"))


@query(with_base("SELECT statement, seq, CASE WHEN derived IS NULL THEN '-' ELSE format('{:,.2f}', derived::DOUBLE) END AS shown FROM chain"))
def money_format(spark, d):
    return chained(spark, d).select("statement", "seq", scalars.money_text(F.col("derived")).alias("shown"))

"""Queries of acceptance and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import report
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans.more import CR, contract
from ledgerloom.plans.registry import chained, moved, query, reconciled, with_base
from ledgerloom.sources import statements


def read_numbers(spark, d):
    """Pages with a printed number that every third page lacks and every eleventh has wrong."""
    p, k = F.col("page"), F.col("statement") + F.col("page")
    return chained(spark, d).select("statement", "page").distinct().select("statement", p.alias("pos"), F.when(k % 3 == 0, None).when(k % 11 == 5, p + 40).otherwise(p + F.when(p > 4, 1).otherwise(0)).cast("int").alias("read"))


NUMBERS = """, rn AS (SELECT statement, page AS pos, (CASE WHEN (statement + page) % 3 = 0 THEN NULL WHEN (statement + page) % 11 = 5 THEN page + 40 ELSE page + CASE WHEN page > 4 THEN 1 ELSE 0 END END)::INT AS read0 FROM (SELECT DISTINCT statement, page FROM chain)),
 rr AS (SELECT statement, pos, CASE WHEN abs(read0 - pos) <= 5 THEN read0 END AS read FROM rn),
 ru AS (SELECT *, last_value(read - pos IGNORE NULLS) OVER (PARTITION BY statement ORDER BY pos ROWS UNBOUNDED PRECEDING) AS u, first_value(read - pos IGNORE NULLS) OVER (PARTITION BY statement ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM rr),
 nn AS (SELECT statement, pos, read, coalesce(read, pos + coalesce(u, w))::INT AS number, CASE WHEN read IS NOT NULL THEN 'read' WHEN coalesce(u, w) IS NULL THEN 'unknown' WHEN u = w THEN 'derived' ELSE 'extrapolated' END AS source FROM ru)
"""


@query(with_base(NUMBERS + "SELECT * FROM nn"))
def page_number_map(spark, d):
    return report.interpolate_numbers(report.anchor_filter(read_numbers(spark, d), 5))


@query(with_base(NUMBERS + "SELECT nn.statement, nn.pos, rn.read0 AS read, number FROM nn JOIN rn USING (statement, pos) WHERE read0 <> number"))
def number_conflicts(spark, d):
    raw = read_numbers(spark, d)
    return report.interpolate_numbers(report.anchor_filter(raw, 5)).select("statement", "pos", "number").join(raw, ["statement", "pos"]).where("read <> number").select("statement", "pos", "read", "number")


@query(with_base("SELECT statement, page, seq, derived FROM (SELECT *, rank() OVER (PARTITION BY page ORDER BY derived DESC NULLS LAST) AS r FROM mv) WHERE r = 1"))
def argmax_with_ties(spark, d):
    return report.top_with_ties(moved(spark, d), "page", "derived").select("statement", "page", "seq", "derived")


@query(with_base(""", a AS (SELECT statement, page, first_balance - last_before AS crossing FROM (SELECT statement, page, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS first_balance, lag(arg_max(balance, seq) FILTER (balance IS NOT NULL)) OVER (PARTITION BY statement ORDER BY page) AS last_before FROM chain GROUP BY statement, page))
 SELECT a.statement, a.page, a.crossing::DECIMAL(18,2) AS crossing, c.seq FROM a JOIN chain c ON c.statement = a.statement AND c.page = a.page AND c.movement = abs(a.crossing)"""))
def boundary_recovery(spark, d):
    from ledgerloom.plans.registry import QUERIES

    return report.boundary_matches(QUERIES["verify_anchors"](spark, d).select("statement", "page", "crossing"), chained(spark, d))


@query(with_base(""", a AS (SELECT statement, seq, ok FROM chain), b AS (SELECT statement, seq, ok OR statement % 3 = 0 AS ok FROM chain WHERE seq % 50 <> 7 OR statement % 2 = 0), j AS (SELECT coalesce(a.statement, b.statement) AS statement, a.ok AS x, b.ok AS y FROM a FULL JOIN b ON a.statement = b.statement AND a.seq = b.seq),
 g AS (SELECT statement, count(*) FILTER (NOT x AND NOT y) AS twice, count(*) FILTER (NOT x) AS first_run, count(*) FILTER (NOT y) AS second_run, count(x) AS n_first, count(y) AS n_second FROM j GROUP BY 1)
 SELECT *, CASE WHEN first_run = 0 THEN 'first' WHEN twice > 0 THEN 'deterministic' WHEN second_run = 0 AND n_second >= n_first THEN 'second' ELSE 'undecided' END AS decision FROM g"""))
def two_run_decision(spark, d):
    rows = chained(spark, d).select("statement", "seq", "ok")
    second = rows.where("seq % 50 <> 7 OR statement % 2 = 0").withColumn("ok", F.col("ok") | (F.col("statement") % 3 == 0))
    return report.two_runs(rows, second, ["statement", "seq"])


@query("""WITH r AS (SELECT event_id // 2 AS k, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 2 = 1 THEN value END AS b FROM events), p AS (SELECT k, max(a) AS a, max(b) AS b FROM r GROUP BY 1 HAVING max(a) IS NOT NULL AND max(b) IS NOT NULL)
 SELECT count(*) AS pairs, count(*) FILTER (a < b) AS a_wins, count(*) FILTER (b < a) AS b_wins, round(quantile_cont(a, 0.5), 6) AS a_median, round(quantile_cont(b, 0.5), 6) AS b_median, round(quantile_cont(a, 0.95), 6) AS a_p95, round(quantile_cont(b, 0.95), 6) AS b_p95, round(avg(b - a), 6) AS mean_difference FROM p""")
def paired_arms(spark, d):
    rows = statements.events(spark, d).select(F.floor(F.col("event_id") / 2).alias("k"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"), "value")
    return report.paired_arms(rows, "k", "arm", "value")


@query(with_base(", x AS (SELECT statement, page, verdict, jump, undecided FROM vd) SELECT 'gap' AS class, count(*) FILTER (jump) AS pages FROM x UNION ALL SELECT 'mismatch', count(*) FILTER (verdict = 'mismatch') FROM x UNION ALL SELECT 'undecided', count(*) FILTER (undecided > 0) FROM x UNION ALL SELECT 'any', count(*) FILTER (jump OR verdict = 'mismatch' OR undecided > 0) FROM x"))
def page_class_census(spark, d):
    return report.census(reconciled(spark, d), {"gap": F.col("jump"), "mismatch": F.col("verdict") == "mismatch", "undecided": F.col("undecided") > 0})


@query(with_base("SELECT 'footer' AS flag, round(avg(CASE WHEN debits IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, round(avg(CASE WHEN debits IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) >= 0.9 AS ready FROM vd UNION ALL SELECT 'closes', round(avg(CASE WHEN delta_check = 'ok' THEN 1.0::DOUBLE ELSE 0 END), 6), round(avg(CASE WHEN delta_check = 'ok' THEN 1.0::DOUBLE ELSE 0 END), 6) >= 0.2 FROM vd"))
def file_readiness(spark, d):
    return report.readiness(reconciled(spark, d), {"footer": (F.col("debits").isNotNull(), 0.9), "closes": (F.col("delta_check") == "ok", 0.2)})


@query(with_base("SELECT statement, page, substr(sha256(string_agg(row_no || '|' || coalesce(date, '') || '|' || description || '|' || coalesce(movement::VARCHAR, '') || '|' || coalesce(balance::VARCHAR, ''), chr(10) ORDER BY seq)), 1, 12) AS seal FROM chain GROUP BY ALL"))
def page_seal(spark, d):
    return report.seal(chained(spark, d))


@query(with_base(""", t AS (SELECT statement, sum(derived) FILTER (side = 'debit')::DECIMAL(18,2) AS truth, list(seq) FILTER (side = 'debit') AS rows, list(seq) FILTER (seq % 3 = 0) AS cited FROM mv GROUP BY 1), a AS (SELECT *, CASE WHEN statement % 4 = 0 THEN truth + 1 WHEN statement % 4 = 1 THEN truth + 0.04 ELSE truth END AS amount FROM t)
 SELECT statement AS question, abs(amount - truth) <= 0.05 AS correct, coalesce(len(list_intersect(cited, rows)) / len(cited) >= 0.3, false) AS cited_well, abs(amount - truth) <= 0.05 AND coalesce(len(list_intersect(cited, rows)) / len(cited) >= 0.3, false) AS passed FROM a WHERE truth IS NOT NULL"""))
def answer_score(spark, d):
    side = F.col("side") == "debit"
    t = moved(spark, d).groupBy("statement").agg(F.sum(F.when(side, F.col("derived"))).cast("decimal(18,2)").alias("truth"), F.collect_list(F.when(side, F.col("seq"))).alias("rows"), F.collect_list(F.when(F.col("seq") % 3 == 0, F.col("seq"))).alias("cited")).where("truth IS NOT NULL")
    k = F.col("statement") % 4
    return report.score_answers(t.withColumn("question", F.col("statement")).withColumn("amount", (F.col("truth") + F.when(k == 0, F.lit("1").cast("decimal(18,2)")).when(k == 1, F.lit("0.04").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))).cast("decimal(18,2)")))


@query(with_base("SELECT regexp_replace(description, ' [0-9]+$', '') AS description, count(*) AS n FROM chain GROUP BY 1"))
def distinct_descriptions(spark, d):
    return chained(spark, d).groupBy(F.regexp_replace("description", " [0-9]+$", "").alias("description")).agg(F.count("*").alias("n"))


@query(with_base("SELECT statement, n AS modal_rows FROM (SELECT statement, n, row_number() OVER (PARTITION BY statement ORDER BY count(*) DESC, n) AS r FROM (SELECT statement, page, count(*) AS n FROM chain GROUP BY ALL) GROUP BY statement, n) WHERE r = 1"))
def modal_page_size(spark, d):
    from pyspark.sql import Window

    sizes = chained(spark, d).groupBy("statement", "page").agg(F.count("*").alias("n")).groupBy("statement", "n").agg(F.count("*").alias("c"))
    return sizes.withColumn("r", F.row_number().over(Window.partitionBy("statement").orderBy(F.desc("c"), "n"))).where("r = 1").select("statement", F.col("n").alias("modal_rows"))


@query(with_base("SELECT round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99 FROM (SELECT derived::DOUBLE AS x FROM mv WHERE derived IS NOT NULL)"))
def percentile_calibration(spark, d):
    names = ("p1", "p5", "p50", "p95", "p99")
    values = exact_quantiles(moved(spark, d), ["derived"], [0.01, 0.05, 0.5, 0.95, 0.99])["derived"]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names))


@query(with_base("SELECT verdict, reason, count(*) AS pages FROM (SELECT verdict, unnest(list_filter([CASE WHEN jump THEN 'jump' END, CASE WHEN undecided > 0 THEN 'undecided' END, CASE WHEN debits IS NULL THEN 'no footer' END], lambda x: x IS NOT NULL)) AS reason FROM vd) GROUP BY ALL"))
def gate_summary(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("jump"), "jump"), F.when(F.col("undecided") > 0, "undecided"), F.when(F.col("debits").isNull(), "no footer")))
    return reconciled(spark, d).select("verdict", F.explode(reasons).alias("reason")).groupBy("verdict", "reason").agg(F.count("*").alias("pages"))


@query(with_base(CR + "SELECT statement, array_to_string(list_sort(list_distinct(list(seq))), ',') AS used FROM (SELECT statement, seq FROM mv WHERE derived > 150 UNION ALL SELECT statement, seq FROM cp WHERE state = 'suspect') GROUP BY 1"))
def used_rows(spark, d):
    rows = contract(spark, d).where("NOT opening AND derived > 150 OR state = 'suspect'")
    return rows.groupBy("statement").agg(F.array_join(F.array_sort(F.collect_set("seq")), ",").alias("used"))


@query(with_base("SELECT statement, seq FROM chain WHERE seq % 3 = 0 INTERSECT SELECT statement, seq FROM chain WHERE NOT ok"))
def suspect_intersection(spark, d):
    rows = chained(spark, d)
    return rows.where("seq % 3 = 0").select("statement", "seq").intersect(rows.where("NOT ok").select("statement", "seq"))


@query(with_base("SELECT statement, page, count(*) FILTER (printed_side IS NULL) AS unprinted, count(*) FILTER (printed_side = side AND side <> '') AS agree, count(*) FILTER (printed_side <> side AND side <> '') AS clash FROM chain GROUP BY ALL"))
def witness_compare(spark, d):
    p, s = F.col("printed_side"), F.col("side")
    return chained(spark, d).groupBy("statement", "page").agg(F.count_if(p.isNull()).alias("unprinted"), F.count_if((p == s) & (s != "")).alias("agree"), F.count_if((p != s) & (s != "")).alias("clash"))


@query(with_base("SELECT statement, page FROM pd WHERE own_debits = 0 AND own_credits = 0 AND (debits - before_debits <> 0 OR credits - before_credits <> 0)"))
def empty_page_failed_read(spark, d):
    from ledgerloom.operators.footers import step

    return reconciled(spark, d).where((F.col("own_debits") == 0) & (F.col("own_credits") == 0) & ((step("debits") != 0) | (step("credits") != 0))).select("statement", "page")


@query(with_base("SELECT statement, page, page % 7 = 0 AS reserved, count(*) FILTER (ok AND derived IS NOT NULL) AS certified, count(*) FILTER (NOT (ok AND derived IS NOT NULL)) AS dropped FROM chain GROUP BY ALL"))
def certified_split(spark, d):
    good = F.col("ok") & F.col("derived").isNotNull()
    return chained(spark, d).groupBy("statement", "page").agg(F.count_if(good).alias("certified"), F.count_if(~good).alias("dropped")).withColumn("reserved", F.col("page") % 7 == 0)


@query(with_base("SELECT statement, page, debits, CASE WHEN delta_check = 'mismatch' AND page % 2 = 0 THEN before_debits + own_debits ELSE debits END::DECIMAL(18,2) AS arbitrated, delta_check = 'mismatch' AND page % 2 = 0 AS changed FROM vd"))
def arbitration(spark, d):
    rows = reconciled(spark, d)
    ruling = rows.where("delta_check = 'mismatch' AND page % 2 = 0").select("statement", "page", (F.col("before_debits") + F.col("own_debits")).cast("decimal(18,2)").alias("new"))
    return rows.join(ruling, ["statement", "page"], "left").select("statement", "page", "debits", F.coalesce("new", "debits").alias("arbitrated"), F.col("new").isNotNull().alias("changed"))

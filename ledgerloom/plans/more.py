"""Further queries: audits, ledger, search, reports and extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import audits, footers, ledger, search
from ledgerloom.plans.registry import chained, moved, query, reconciled, with_base
from ledgerloom.sources import statements

#: Contract rows in DuckDB.
CR = """, cr AS (SELECT *, CASE WHEN balance IS NULL THEN 'summary' WHEN opening AND coalesce(movement, 0) <> 0 THEN 'gap_anchor' WHEN opening THEN 'opening' WHEN derived = 0 THEN 'no_movement' WHEN NOT ok THEN 'suspect' ELSE 'ok' END AS state FROM chain),
 cp AS (SELECT *, CASE WHEN state = 'ok' THEN CASE WHEN side = '' THEN 'printed' ELSE 'chain' END WHEN state = 'gap_anchor' THEN 'gap' ELSE '' END AS proof, state IN ('ok', 'suspect') AS counted, CASE WHEN state = 'gap_anchor' THEN movement ELSE derived END AS amount FROM cr)
"""
ONLY = {"Card payment": "debit", "Service fee": "debit", "Standing order": "debit", "Transfer received": "credit", "Deposit": "credit"}


def contract(spark, d):
    return audits.contract_rows(chained(spark, d))


def relabelled(rows):
    """Some rows carry a label of the other side."""
    return rows.withColumn("description", F.when(F.col("seq") % 13 == 5, F.regexp_replace("description", "^Card payment", "Deposit")).when(F.col("seq") % 13 == 6, F.regexp_replace("description", "^(Deposit|Transfer received)", "Card payment")).otherwise(F.col("description")))


RELABELLED = ", rl AS (SELECT * REPLACE (CASE seq % 13 WHEN 5 THEN regexp_replace(description, '^Card payment', 'Deposit') WHEN 6 THEN regexp_replace(description, '^(Deposit|Transfer received)', 'Card payment') ELSE description END AS description) FROM chain)"


@query(with_base(RELABELLED + """ SELECT statement, seq, description, side, only_side FROM (SELECT *, CASE WHEN description LIKE 'Card payment%' OR description LIKE 'Service fee%' OR description LIKE 'Standing order%' THEN 'debit' WHEN description LIKE 'Transfer received%' OR description LIKE 'Deposit%' THEN 'credit' END AS only_side FROM rl WHERE NOT opening AND side <> '') WHERE only_side <> side"""))
def desc_side_clash(spark, d):
    return audits.label_clash(relabelled(chained(spark, d)), ONLY)


@query(with_base("SELECT statement, seq, printed_side, side FROM chain WHERE printed_side IS NOT NULL AND side <> '' AND printed_side <> side"))
def column_vs_chain(spark, d):
    return audits.column_clash(chained(spark, d))


@query(with_base(RELABELLED + " SELECT statement, seq, side FROM rl WHERE side = 'credit' AND NOT opening AND (description LIKE 'Card payment%' OR description LIKE 'Service fee%')"))
def shift_suspects(spark, d):
    return audits.label_clash(relabelled(chained(spark, d)), {"Card payment": "debit", "Service fee": "debit"}).select("statement", "seq", "side")


@query(with_base(""", u AS (SELECT *, last_value(iso IGNORE NULLS) OVER (PARTITION BY statement ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM ci)
 SELECT statement, seq, CASE WHEN iso IS NOT NULL THEN 'cell' WHEN opening THEN 'not_a_movement' WHEN above IS NOT NULL THEN 'inherited' ELSE 'missing' END AS date_source, CASE WHEN iso IS NOT NULL THEN iso WHEN NOT opening THEN above END AS date_filled FROM u"""))
def fill_dates(spark, d):
    rows = chained(spark, d).withColumn("iso", scalars.iso_date(F.col("date")))
    return audits.fill_dates(rows).select("statement", "seq", "date_source", "date_filled")


@query(with_base(""", dd AS (SELECT *, lag(iso) OVER (PARTITION BY statement, page ORDER BY seq) AS up FROM ci WHERE iso IS NOT NULL),
 g AS (SELECT statement, page, arg_min(iso, seq) AS f, arg_max(iso, seq) AS l, count(*) FILTER (iso < up) AS i FROM dd GROUP BY ALL), h AS (SELECT *, lag(l) OVER (PARTITION BY statement ORDER BY page) AS b FROM g),
 k AS (SELECT statement, count(*) FILTER (f < b) AS x, sum(i)::BIGINT AS y FROM h GROUP BY 1), s AS (SELECT statement, round(avg(CASE WHEN iso IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS dated_share FROM ci GROUP BY 1)
 SELECT statement, coalesce(x, 0) AS between_pages, coalesce(y, 0) AS within_pages, dated_share FROM s LEFT JOIN k USING (statement)"""))
def date_inversions(spark, d):
    return audits.date_inversions(chained(spark, d).withColumn("iso", scalars.iso_date(F.col("date"))))


@query(with_base(""", e0 AS (SELECT statement, page, CASE (statement + page * page) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'dot' WHEN 2 THEN 'dot' WHEN 3 THEN 'comma' ELSE 'mixed' END AS era FROM (SELECT DISTINCT statement, page FROM chain)),
 e1 AS (SELECT *, last_value(CASE WHEN era <> 'none' THEN era END IGNORE NULLS) OVER (PARTITION BY statement ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le, lag(era) OVER w AS u, lead(era) OVER w AS n FROM e0 WINDOW w AS (PARTITION BY statement ORDER BY page))
 SELECT statement, page, era, coalesce(era <> 'none' AND era <> le, false) AS changed, coalesce(u = n AND era <> u, false) AS outlier FROM e1"""))
def era_transitions(spark, d):
    k = (F.col("statement") + F.col("page") * F.col("page")) % 5
    pages = chained(spark, d).select("statement", "page").distinct().withColumn("era", F.when(k == 0, "none").when(k < 3, "dot").when(k == 3, "comma").otherwise("mixed"))
    return audits.era_transitions(pages)


@query(with_base(CR + "SELECT statement, seq, state, proof, counted, amount FROM cp"))
def contract_rows(spark, d):
    return contract(spark, d).select("statement", "seq", "state", "proof", "counted", "amount")


@query(with_base(", i AS (SELECT statement, page, page - row_number() OVER (PARTITION BY statement ORDER BY page) AS k FROM (SELECT DISTINCT statement, page FROM chain)), g AS (SELECT statement, k, min(page) AS from_page, count(*) AS length FROM i GROUP BY ALL) SELECT statement, from_page, length FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY length DESC, from_page) AS r FROM g) WHERE r = 1"))
def longest_run(spark, d):
    return audits.islands(chained(spark, d))


@query(with_base(CR + """, o AS (SELECT statement, arg_max(balance, seq) FILTER (balance IS NOT NULL) - arg_min(balance, seq) FILTER (balance IS NOT NULL) - coalesce(sum(amount) FILTER (counted AND side = 'credit'), 0) + coalesce(sum(amount) FILTER (counted AND side = 'debit'), 0) AS off FROM cp GROUP BY 1),
 k AS (SELECT count(*) FILTER (state = 'suspect') AS suspect, count(*) FILTER (counted AND amount IS NULL) AS bare, count(*) FILTER (counted AND side = 'credit' AND (description LIKE 'Card payment%' OR description LIKE 'Service fee%' OR description LIKE 'Standing order%') OR counted AND side = 'debit' AND (description LIKE 'Transfer received%' OR description LIKE 'Deposit%')) AS clash, count(*) FILTER (side <> '' AND printed_side <> side) AS col FROM cp),
 f AS (SELECT 'balances, money in and money out agree' AS "check", count(*) FILTER (off <> 0) AS failures FROM o UNION ALL SELECT 'page sums agree with printed totals', count(*) FILTER (delta_check = 'mismatch') FROM vd UNION ALL SELECT 'no sheets are missing', count(*) FILTER (jump) FROM vd
  UNION ALL SELECT 'no suspect rows', suspect FROM k UNION ALL SELECT 'every counted row has an amount', bare FROM k UNION ALL SELECT 'no description of the other side', clash FROM k UNION ALL SELECT 'no amount in the other column', col FROM k)
 SELECT "check", failures, failures = 0 AS passed FROM f"""))
def close_gate(spark, d):
    return audits.close_gate(contract(spark, d), reconciled(spark, d), ONLY)


# the ledger


@query(with_base(CR + "SELECT vd.statement, vd.page, verdict, count(*) AS stored, count(*) FILTER (counted) AS counted, count(*) FILTER (NOT ok) AS broken FROM vd JOIN cp USING (statement, page) GROUP BY ALL"))
def coverage(spark, d):
    totals = footers.page_totals(contract(spark, d), stored=F.count("*"), n_counted=F.count_if("counted"), broken=F.count_if(~F.col("ok")))
    pages = footers.with_footers(totals, statements.statement_footers(statements.events(spark, d)))
    return footers.verdict(footers.delta(footers.cumulative(pages))).select("statement", "page", "verdict", "stored", F.col("n_counted").alias("counted"), "broken")


@query(with_base(CR + "SELECT statement, seq, page, state FROM cp WHERE proof = '' AND state <> 'summary'"))
def unproven(spark, d):
    return ledger.unproven(contract(spark, d))


@query(with_base(CR + "SELECT statement, side, sum(amount)::DECIMAL(18,2) AS total, count(*) AS n FROM cp WHERE counted GROUP BY ALL"))
def ledger_totals(spark, d):
    return ledger.totals(contract(spark, d))


@query(with_base("SELECT statement, p::INT AS page FROM (SELECT statement, unnest(range(1, max(page) + 1)) AS p FROM chain GROUP BY statement) x WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.statement = x.statement AND c.page = x.p)"))
def unread_pages(spark, d):
    rows = chained(spark, d)
    return ledger.unread_pages(rows, rows.groupBy("statement").agg(F.max("page").alias("last_page")))


@query(with_base(""", o AS (SELECT statement, page, row_no, row_number() OVER (PARTITION BY statement ORDER BY page, row_no) AS row_id FROM srows WHERE seq % 3 <> 0), n AS (SELECT statement, page, row_no, description FROM srows WHERE seq % 7 <> 0),
 j AS (SELECT n.*, o.row_id AS old_id, t.top FROM n LEFT JOIN o USING (statement, page, row_no) LEFT JOIN (SELECT statement, max(row_id) AS top FROM o GROUP BY 1) t USING (statement))
 SELECT statement, page, row_no, description, coalesce(old_id, coalesce(top, 0) + row_number() OVER (PARTITION BY statement, old_id IS NULL ORDER BY page, row_no)) AS row_id FROM j"""))
def ingest_prune(spark, d):
    rows = statements.statement_rows(statements.events(spark, d))
    old = rows.where("seq % 3 <> 0").withColumn("row_id", F.row_number().over(Window.partitionBy("statement").orderBy("page", "row_no")).cast("long"))
    new = rows.where("seq % 7 <> 0").select("statement", "page", "row_no", "description")
    return ledger.ingest(old.select("statement", "page", "row_no", "row_id"), new, ["statement", "page", "row_no"])


@query(with_base("SELECT statement AS question, count(*) AS cited, count(*) FILTER (seq % 4 = 0 OR opening) AS unsupported FROM chain WHERE seq % 2 = 0 GROUP BY 1"))
def citation_truth(spark, d):
    rows = chained(spark, d)
    cited = rows.where("seq % 2 = 0").select(F.col("statement").alias("question"), "seq")
    return ledger.citation_check(cited, rows.where("NOT opening AND seq % 4 <> 0").select(F.col("statement").alias("question"), "seq"))


@query(with_base("SELECT statement, page, cum_check AS old_verdict, verdict AS new_verdict, page % 2 = 0 AS explained FROM vd WHERE cum_check IS DISTINCT FROM verdict"))
def verdict_diff(spark, d):
    rows = reconciled(spark, d)
    return ledger.compare_verdicts(rows.select("statement", "page", F.col("cum_check").alias("verdict")), rows, rows.where("page % 2 = 0"))


@query(with_base(", q AS (SELECT DISTINCT statement FROM chain), e AS (SELECT statement, seq FROM mv WHERE derived > 200) SELECT q.statement AS question, count(e.seq) AS evidence FROM q LEFT JOIN e USING (statement) GROUP BY 1"))
def qa_evidence(spark, d):
    rows = moved(spark, d)
    return rows.select("statement").distinct().join(rows.where("derived > 200").select("statement", "seq"), "statement", "left").groupBy(F.col("statement").alias("question")).agg(F.count("seq").alias("evidence"))


@query(with_base(", a AS (SELECT statement, page, derived AS v, count(*) AS n FROM chain WHERE derived IS NOT NULL GROUP BY ALL), b AS (SELECT statement, page, movement AS v, count(*) AS n FROM chain WHERE movement IS NOT NULL GROUP BY ALL) SELECT statement, page, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS shared, coalesce(sum(a.n), 0)::BIGINT AS n_one, coalesce(sum(b.n), 0)::BIGINT AS n_other FROM a FULL JOIN b USING (statement, page, v) GROUP BY ALL"))
def multiset_compare(spark, d):
    rows = chained(spark, d)
    one = rows.where("derived IS NOT NULL").select("statement", "page", F.col("derived").alias("v"))
    return ledger.multiset_overlap(one, rows.where("movement IS NOT NULL").select("statement", "page", F.col("movement").alias("v")), ["statement", "page"], "v")


# search


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
 h AS (SELECT doc_id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, (SELECT unnest(['benchmark', 'license', 'water', 'the']) AS t)), f AS (SELECT t, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f USING (t), s WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def fts_bm25(spark, d):
    return search.bm25(spark.read.parquet(f"{d}/documents.parquet"), ["benchmark", "license", "water", "the"])


@query(with_base("SELECT statement, page, ((rn - 1) // 4)::INT AS chunk, min(seq) AS from_seq, max(seq) AS to_seq, string_agg(coalesce(date, '-') || ' | ' || description || ' | ' || coalesce(balance::VARCHAR, '-'), chr(10) ORDER BY seq) AS text FROM (SELECT *, row_number() OVER (PARTITION BY statement, page ORDER BY seq) AS rn FROM chain) GROUP BY ALL"))
def chunk_rows(spark, d):
    return search.chunks(chained(spark, d), 4)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), r AS (SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS r FROM r)
 SELECT vec_id, label, distance, (r > 2)::INT AS tier FROM n WHERE r <= 10 ORDER BY (r > 2)::INT, distance, vec_id LIMIT 10""")
def knn_quota(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return search.nearest_with_quota(vectors, list(vectors.orderBy("vec_id").select("embedding").first()[0]))


@query("""WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), k AS (SELECT * FROM t QUALIFY exchange > max(exchange) OVER (PARTITION BY conv_id) - 2 AND exchange > 0)
 SELECT conv_id, turn, role, exchange::BIGINT AS exchange, n - count(*) OVER (PARTITION BY conv_id) AS dropped FROM k""")
def memory_window(spark, d):
    return search.last_turns(spark.read.parquet(f"{d}/conversations.parquet"), 2)


@query(with_base("SELECT event_id, CASE event_id % 4 WHEN 0 THEN [page] WHEN 1 THEN [page, page + 1, page + 2] WHEN 2 THEN [page, page + 5] ELSE [] END::INT[] AS pages FROM tm"))
def page_mentions(spark, d):
    p = F.col("page")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("What is on page "), p, F.lit("?"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sum pages "), p, F.lit(" - "), p + 2)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Pages "), p, F.lit(", "), p + 5, F.lit(" please"))).otherwise("The closing balance?")
    return statements.true_movements(statements.events(spark, d)).select("event_id", F.coalesce(scalars.page_mentions(text), F.array().cast("array<int>")).alias("pages"))


@query(with_base(""", f AS (SELECT statement, max(page) AS last, min(iso) AS a, max(iso) AS b FROM ci GROUP BY 1), q AS (SELECT f.*, unnest([2, 500]) AS asked_page, unnest(['2024-01-10', '1999-01-01']) AS asked_day FROM f)
 SELECT statement, asked_page, CASE WHEN asked_page > last THEN 'page_outside' WHEN NOT EXISTS (SELECT 1 FROM chain c WHERE c.statement = q.statement AND c.page = asked_page) THEN 'page_unread' WHEN asked_day < a OR asked_day > b THEN 'period_outside' ELSE 'answerable' END AS scope FROM q"""))
def scope_gate(spark, d):
    rows = chained(spark, d).withColumn("iso", scalars.iso_date(F.col("date")))
    facts = rows.groupBy("statement").agg(F.max("page").alias("last"), F.min("iso").alias("a"), F.max("iso").alias("b"), F.collect_set("page").alias("read"))
    asked = F.explode(F.array(F.struct(F.lit(2).alias("p"), F.lit("2024-01-10").alias("d")), F.struct(F.lit(500).alias("p"), F.lit("1999-01-01").alias("d"))))
    q = facts.select("*", asked.alias("q"))
    return q.select("statement", F.col("q.p").alias("asked_page"), F.when(F.col("q.p") > F.col("last"), "page_outside").when(~F.expr("array_contains(read, q.p)"), "page_unread").when((F.col("q.d") < F.col("a")) | (F.col("q.d") > F.col("b")), "period_outside").otherwise("answerable").alias("scope"))


# reports


@query(with_base(CR + """SELECT statement, count(*) AS n_rows, count(DISTINCT page) AS pages, count(*) FILTER (counted) AS counted, min(iso) AS first_day, max(iso) AS last_day, max(amount) FILTER (counted) AS biggest, min(amount) FILTER (counted) AS smallest, median(amount::DOUBLE) FILTER (counted) AS median_amount, count(*) FILTER (date IS NULL) AS missing_dates
 FROM (SELECT cp.*, ci.iso FROM cp JOIN ci USING (statement, seq)) GROUP BY statement"""))
def summary_facts(spark, d):
    rows = contract(spark, d).withColumn("iso", scalars.iso_date(F.col("date")))
    c = F.col("counted")
    return rows.groupBy("statement").agg(F.count("*").alias("n_rows"), F.count_distinct("page").alias("pages"), F.count_if("counted").alias("counted"), F.min("iso").alias("first_day"), F.max("iso").alias("last_day"), F.max(F.when(c, F.col("amount"))).alias("biggest"), F.min(F.when(c, F.col("amount"))).alias("smallest"), F.percentile(F.when(c, F.col("amount").cast("double")), 0.5).alias("median_amount"), F.count_if(F.col("date").isNull()).alias("missing_dates"))


@query(with_base("""SELECT statement, count(*) AS n, count(*) FILTER (ok) AS hits, round((p + 1.959964 * 1.959964 / (2 * n0) - 1.959964 * sqrt(p * (1 - p) / n0 + 1.959964 * 1.959964 / (4 * n0 * n0))) / (1 + 1.959964 * 1.959964 / n0), 6) AS low, round((p + 1.959964 * 1.959964 / (2 * n0) + 1.959964 * sqrt(p * (1 - p) / n0 + 1.959964 * 1.959964 / (4 * n0 * n0))) / (1 + 1.959964 * 1.959964 / n0), 6) AS high
 FROM (SELECT *, count(*) OVER (PARTITION BY statement)::DOUBLE AS n0, (count(*) FILTER (ok) OVER (PARTITION BY statement))::DOUBLE / count(*) OVER (PARTITION BY statement) AS p FROM chain) GROUP BY statement, n0, p"""))
def wilson_interval(spark, d):
    out = chained(spark, d).groupBy("statement").agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"))
    w = scalars.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return out.select("statement", "n", "hits", w.low.alias("low"), w.high.alias("high"))


@query(with_base("SELECT statement, CASE WHEN date IS NULL THEN 'none' WHEN regexp_matches(date, '[٠-٩]') THEN 'arabic' ELSE 'latin' END AS encoding, count(*) AS n FROM chain GROUP BY ALL"))
def date_encoding(spark, d):
    e = F.when(F.col("date").isNull(), "none").when(F.col("date").rlike("[٠-٩]"), "arabic").when(F.col("date").rlike("[۰-۹]"), "persian").otherwise("latin")
    return chained(spark, d).groupBy("statement", e.alias("encoding")).agg(F.count("*").alias("n"))


@query(with_base("""SELECT a.statement, a.page, CASE WHEN b.n IS NULL THEN 'old' WHEN b.ok > a.ok THEN 'new' WHEN b.ok < a.ok THEN 'old' ELSE 'tie' END AS better FROM (SELECT statement, page, count(*) AS n, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS ok FROM chain GROUP BY ALL) a
 LEFT JOIN (SELECT statement, page, count(*) AS n, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS ok FROM chain WHERE seq % 5 <> 0 GROUP BY ALL) b USING (statement, page)"""))
def paired_rounds(spark, d):
    rows = chained(spark, d)
    rate = lambda t, n: t.groupBy("statement", "page").agg(F.avg(F.col("ok").cast("double")).alias(n))
    both = rate(rows, "a").join(rate(rows.where("seq % 5 <> 0"), "b"), ["statement", "page"], "left")
    return both.select("statement", "page", F.when(F.col("b").isNull(), "old").when(F.col("b") > F.col("a"), "new").when(F.col("b") < F.col("a"), "old").otherwise("tie").alias("better"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\\p{L}{2,}')) AS w FROM benchmark), p AS (SELECT a.item_id AS one, b.item_id AS other, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM t a JOIN t b ON b.item_id = a.item_id + 1)
 SELECT one, other, round(i::DOUBLE / (s - i), 6) AS similarity FROM p""")
def desc_similarity(spark, d):
    t = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_distinct(scalars.bag_of_words(F.col("text"))).alias("w"))
    p = t.select(F.col("item_id").alias("one"), F.col("w").alias("a")).join(t.select(F.col("item_id").alias("other"), (F.col("item_id") - 1).alias("one"), F.col("w").alias("b")), "one")
    i = F.size(F.array_intersect("a", "b"))
    return p.select("one", "other", F.round(i.cast("double") / (F.size("a") + F.size("b") - i), 6).alias("similarity"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def identity_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.short_key(F.col("text")).alias("key"))


@query(with_base("SELECT statement, page, min(seq) AS cut FROM (SELECT *, sum(coalesce(derived, 0)) OVER (PARTITION BY statement, page ORDER BY seq) AS spent FROM mv) WHERE spent >= 300 GROUP BY ALL"))
def budget_cut_off(spark, d):
    order = Window.partitionBy("statement", "page").orderBy("seq")
    rows = moved(spark, d).withColumn("spent", F.sum(F.coalesce("derived", F.lit(0))).over(order))
    return rows.where("spent >= 300").groupBy("statement", "page").agg(F.min("seq").alias("cut"))


@query(with_base("SELECT statement, seq FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY statement ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM chain) WHERE s >= 2"))
def stop_gate(spark, d):
    order = Window.partitionBy("statement").orderBy("seq").rowsBetween(-4, 0)
    return chained(spark, d).withColumn("s", F.sum((~F.col("ok")).cast("int")).over(order)).where("s >= 2").select("statement", "seq")


# extensions: time windows over the events


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    return statements.events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))



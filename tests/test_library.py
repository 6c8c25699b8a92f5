import datetime
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as s
from ledgerloom.functions import texts
from ledgerloom.operators import audits, chain, footers, ledger, search, tools
from ledgerloom.plans import evidence
from ledgerloom.sources import readers, statements
from ledgerloom.streaming import pages

ROW = "statement long, seq int, page int, description string, movement decimal(18,2), balance decimal(18,2)"


def derive(spark, *rows):
    data = [(1, i + 1, p, d, None if m is None else D(m), None if b is None else D(b)) for i, (p, d, m, b) in enumerate(rows)]
    return {r.seq: r for r in chain.derive(spark.createDataFrame(data, ROW)).collect()}


def test_chain_cases(spark):
    r = derive(spark, (1, "start", None, "40"), (1, "a", "5", "45"), (1, "b", "500", "50"), (1, "c", "7", "60"), (1, "d", "1", None), (1, "e", "3", "63"), (2, "top", None, "63"), (3, "x", "15", "78"), (4, "x", "15", "100"), (5, "x", None, "101"))
    assert (r[1].opening, r[1].derived, r[1].ok) == (True, 0, True)
    assert (r[2].side, r[2].derived, r[2].ok) == ("credit", 5, True)
    assert (r[3].scale_fixed, r[3].ok, r[3].derived) == (True, True, 5)
    assert (r[4].ok, r[4].derived) == (False, 10)
    assert (r[5].derived, r[5].side, r[5].ok) == (None, "", False)
    assert (r[6].derived, r[6].side, r[6].ok, r[6].opening) == (3, "", True, False)
    assert [r[i].boundary for i in (7, 8, 9, 10)] == ["carry", "txn", "anchor", "anchor"]


@pytest.mark.parametrize(("token", "amount"), [("1,234.56", "1234.56"), ("12,34", "12.34"), ("1,234", "1234"), ("1,23456", "1234.56"), ("12.5", None), ("12.", "12"), (".,", "0"), (".", None), ("7.25-", "-7.25"), ("-٣٫٥٠", "-3.50"), ("۱۲", "12"), ("abc", None), ("", None), (None, None), ("5,1", "5")])
def test_amounts(spark, token, amount):
    got = spark.createDataFrame([(token,)], "t string").select(s.parse_amount(F.col("t"))).first()[0]
    assert got == (None if amount is None else D(amount))


@pytest.mark.parametrize(("cell", "iso", "status"), [("2024-01-05", "2024-01-05", "ok"), ("٢٠٢٤/٠١/٠٥", "2024-01-05", "ok"), ("14450101 20240105", "2024-01-05", "ok"), ("2024-02-30", None, "implausible"), ("18000101", None, "implausible"), ("2024", None, "incomplete"), (None, None, "missing")])
def test_dates(spark, cell, iso, status):
    got = spark.createDataFrame([(cell,)], "t string").select(s.read_date(F.col("t")).alias("r")).first().r
    assert (got.iso if got.status == "ok" else None, got.status) == (iso, status)


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(s.page_mentions(F.lit("page 3, 5-7 and 9; pages 1 to 99"))) == [1, 3, 5, 6, 7, 9, 99]
    assert one(s.one_digit_apart(F.lit("12.34"), F.lit("12.94"))) and not one(s.one_digit_apart(F.lit("1"), F.lit("12")))
    assert one(s.money_text(F.lit(D("1234.5")))) == "1,234.50" and one(s.money_text(F.lit(None).cast("decimal(18,2)"))) == "-"
    assert one(s.transaction_kind(F.lit("TRANSFER to x"), F.lit("debit"))) == "transfer_out"
    assert one(s.side_of_label(F.lit(" Dr "))) == "debit" and one(s.side_of_label(F.lit("?"))) == ""
    assert one(s.parse_amount_ocr(F.lit("oops"))) == 0 and one(s.parse_amount_ocr(F.lit("1.234,5"))) == D("1234.50")
    assert one(s.wilson(F.lit(0.0), F.lit(0.0))).low is None


def test_unknown_arguments_are_errors(spark):
    rows = spark.createDataFrame([], "side string, iso string")
    with pytest.raises(ValueError, match="no such side"):
        tools.select(rows, side="sideways")
    with pytest.raises(ValueError, match="ends before"):
        tools.select(rows, since="2024-02-01", until="2024-01-01")


def reconcile(spark, own, printed):
    o = spark.createDataFrame([(1, p, D(d), D(c), D(b), 0) for p, d, c, b in own], "statement long, page int, own_debits decimal(18,2), own_credits decimal(18,2), own_balance decimal(18,2), undecided long")
    f = spark.createDataFrame([(1, p, *[None if x is None else D(x) for x in v]) for p, *v in printed], "statement long, page int, debits decimal(18,2), credits decimal(18,2), balance decimal(18,2)")
    return footers.verdict(footers.delta(footers.cumulative(footers.with_footers(o, f))))


def test_verdicts(spark):
    rows = reconcile(spark, [(1, "5", "0", "95"), (2, "0", "9", "104"), (3, "1", "1", "104"), (4, "2", "2", "104"), (6, "3", "3", "104")], [(1, "5", "0", "95"), (2, "5", "9", "104"), (3, "6", "12", "104"), (4, None, None, None), (6, "11", "17", "104")])
    got = {r.page: (r.verdict, r.cum_check) for r in rows.collect()}
    assert got[1] == ("ok", "ok") and got[2] == ("ok", "ok")
    assert got[3] == ("mismatch", "mismatch") and got[4][0] == "absent"
    assert got[6] == ("unchecked", "mismatch")
    spans = {r.from_page: (r.held, r.gained) for r in footers.spans(rows).collect()}
    assert spans[2] == (True, 0) and spans[4] == (False, 0)


def test_hundredfold_paradox(spark):
    rows = reconcile(spark, [(1, "1", "1", "0"), (2, "5", "700", "0")], [(1, "1", "1", "0"), (2, "6", "8", "0")])
    assert [r.page for r in rows.where("paradox").collect()] == [2]


def test_fewest_moved(spark):
    got = footers.fewest_moved(spark.createDataFrame([(1, p, r) for p, r in [(1, 1), (2, 3), (3, 2), (4, 4), (5, 5)]], "statement long, page int, rank int"))
    assert sum(r.moved for r in got.collect()) == 1


def test_balance_repair(spark):
    rows = spark.createDataFrame([(1, i, D(m), D(b)) for i, (m, b) in enumerate([("1", "100"), ("5", "105"), ("10", "195"), ("5", "120"), ("7", "990")])], "statement long, seq int, movement decimal(18,2), balance decimal(18,2)")
    got = {r.seq: (r.balance, r.repaired) for r in footers.repair_balances(rows).collect()}
    assert got[2] == (D("115"), True) and got[4] == (D("990"), False)


def test_ingest_keeps_ids_and_prunes(spark):
    old = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "statement long, row_no int, row_id long")
    new = spark.createDataFrame([(1, 1), (1, 3), (1, 4)], "statement long, row_no int")
    assert {(r.row_no, r.row_id) for r in ledger.ingest(old, new, ["statement", "row_no"]).collect()} == {(1, 1), (3, 3), (4, 4)}


def test_label_clash_bites_only_faults(spark):
    rows = spark.createDataFrame([(1, 1, "Fee x", "credit", False), (1, 2, "Fee y", "debit", False), (1, 3, "Fee z", "", False)], "statement long, seq int, description string, side string, opening boolean")
    assert [r.seq for r in audits.label_clash(rows, {"Fee": "debit"}).collect()] == [1]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b rare"), (3, "b b"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in search.bm25(docs, ["rare", "b"]).collect()][0] == 2


def test_readers(spark, tmp_path):
    page = {"statement": 1, "page": 2, "footer": {"debits": "1,00", "credits": None, "balance": "9.00"}, "rows": [{"date": "2024-01-02", "description": "x", "movement": "1.00", "balance": "٩٫٠٠"}], "stamp": "r1"}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.json").write_text(json.dumps(page) + "\n{broken\n")
    got = readers.checkpoints(spark, f"{tmp_path}/pages")
    r = readers.rows_of_checkpoints(got).first()
    assert (r.page, r.seq, r.movement, r.balance) == (2, 1, D("1.00"), D("9.00"))
    assert readers.footers_of_checkpoints(got).first().debits == D("1.00")
    assert readers.publishable(got, "r1").first().kind == "matching"
    text = spark.createDataFrame([(1, "2024-01-02 Card 5.00 95.00\nnoise\n2024-01-03 Fee 0.00 2.00 93.00\f2024-01-04 Only 90.00")], "statement long, text string")
    rows = {(r.page, r.line_no): r for r in readers.rows_of_text(readers.pages_of_text(text)).collect()}
    assert (rows[1, 0].movement, rows[1, 0].balance, rows[1, 0].description) == (D("5.00"), D("95.00"), "Card")
    assert (rows[1, 2].movement, rows[1, 2].printed_side) == (D("2.00"), "credit")
    assert (rows[2, 0].movement, rows[2, 0].balance) == (None, D("90.00"))
    answers = spark.createDataFrame([(1, 'Sure: [{"description": "a", "movement": "1"},]'), (2, '{"rows": [{"description": "b"}]}'), (3, "none")], "id long, answer string")
    assert sorted((r.id, r.description) for r in readers.answer_rows(answers).collect() if r.description) == [(1, "a"), (2, "b")]
    w = readers.witness_rows(spark.createDataFrame([(1, "ROW|10.5|1.00|2.00"), (1, "ROW|x"), (1, "COLS|1|2")], "page int, line string"))
    assert [(r.x, r.amount) for r in w.collect()] == [(10.5, D("1.00"))]


def test_page_stream_takes_each_page_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda p: json.dumps({"statement": 1, "page": p, "rows": []})
    for n, p in enumerate((1, 2)):
        (tmp_path / f"in/{n}.json").write_text(line(p))
        pages.take_in(pages.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == p


def test_activity_windows(spark):
    t = datetime.datetime(2024, 1, 1, 10, 5)
    ev = spark.createDataFrame([(t, "a", 1.0, 1), (t + datetime.timedelta(minutes=20), "a", 2.0, 1), (t + datetime.timedelta(hours=3), "a", 4.0, 1)], "ts timestamp, event_type string, value double, user_id long")
    assert sorted(r.total for r in pages.activity(ev).collect()) == [3.0, 4.0]
    assert sorted(r.n for r in pages.sessions(ev).collect()) == [1, 2]


@pytest.mark.parametrize(("token", "export", "evaluation", "witness"), [("300,00", "30000", "300", "30000"), ("٣٠٠,٠٠", "300", "300", "30000"), ("1234,25", "123425", "1234.25", "123425"), ("1.234", "1.23", "1234", "1.23"), ("1.234,56", "1.23", "1234.56", "1.23"), ("1,234,25", "123425", None, "123425"), ("50-", None, "50", "50"), ("-7.5", "-7.5", "-7.5", "7.5"), ("SAR 9.10", None, "9.10", "9.10"), ("1.2.3", None, None, None), ("٠٫٥٠", "0.5", "0.5", "0.5"), ("", None, None, None), (None, None, None, None)])
def test_number_parsers(spark, token, export, evaluation, witness):
    c = F.col("t")
    got = spark.createDataFrame([(token,)], "t string").select(texts.number_of_export(c).alias("e"), texts.number_of_evaluation(c).alias("v"), texts.number_of_witness(c).alias("w")).first()
    want = [None if x is None else D(x) for x in (export, evaluation, witness)]
    if token == "1.234,56":  # commas go first: 1.23456
        assert got.e == D("1.23") and got.w == D("1.23")
    assert list(got) == want


@pytest.mark.parametrize(("token", "amount"), [(".25", None), ("1.2.3", "1.23"), ("abc.,", None), (". ,", "0"), ("7.5.", None), ("7.50 -", "-7.50")])
def test_amounts_with_odd_separators(spark, token, amount):
    got = spark.createDataFrame([(token,)], "t string").select(s.parse_amount(F.col("t"))).first()[0]
    assert got == (None if amount is None else D(amount))


@pytest.mark.parametrize(("cell", "iso"), [("2024/1/5", "2024-01-05"), ("20240105", "2024-01-05"), ("٢٠٢٤.٠١.٠٥", "2024-01-05"), ("1444/01/05", None), ("2024-02-30", None), ("2101-01-01", None), ("202415", None), (None, None)])
def test_date_cells(spark, cell, iso):
    assert spark.createDataFrame([(cell,)], "t string").select(texts.date_of_cell(F.col("t"))).first()[0] == iso


def test_dates_in_prose(spark):
    one = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(texts.dates_in_text(F.col("t")).alias("d")).first().d)
    assert one("ref 14450630 of 20240105, 20250101") == ("2024-01-05", "1445-06-30")
    assert one("12345678 and 2024/01/05") == (None, None)
    assert one("20241301 then ٢٠٢٤٠١٠٥") == ("2024-01-05", None)


def test_citations_without_page_only_where_no_page_is_cited(spark):
    one = lambda t: [tuple(c) for c in spark.createDataFrame([(t,)], "t string").select(texts.citations(F.col("t")).alias("c")).first().c or []]
    assert one("page 3 rows 4-7, and row 9") == [(3, 4, 7)]
    assert one("rows 7 to 4 and Row 9") == [(None, 4, 7), (None, 9, 9)]
    assert one("Page 2: row 5; page 3, in its rows 8–6") == [(2, 5, 5), (3, 6, 8)]
    assert one("page 2 has nothing on anything like rows 5") == [(None, 5, 5)]
    assert one("nothing") == one(None) == []


def test_repairs_take_the_lesser_candidate_first_and_leave_equal_neighbours(spark):
    def repaired(*rows):
        data = [(1, i, None if m is None else D(m), D(b)) for i, (m, b) in enumerate(rows, 1)]
        out = footers.repair_balances(spark.createDataFrame(data, "statement long, seq int, movement decimal(18,2), balance decimal(18,2)")).orderBy("seq").collect()
        return [(str(r.balance), r.repaired) for r in out]

    assert repaired((None, "55.62"), ("5", "51.62"), ("22", "28.62")) == [("55.62", False), ("50.62", True), ("28.62", False)]
    assert repaired((None, "55.62"), ("5", "51.62"), ("0", "50.62"))[1] == ("51.62", False)  # the next balance would not move
    assert repaired((None, "55.00"), ("5", "10.00"), ("30", "30.00"))[1] == ("60.00", True)
    assert repaired((None, "55.00"), ("5", "50.00"), ("5", "55.00"))[1] == ("60.00", True)  # rows that close are tried, too


def test_tasks_of_statements_stay_small_as_events_grow(spark):
    ev = lambda n: spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 997 AS user_id", "'click' AS event_type", "1.0D AS value")
    for n, tasks in ((10, 1), (70_000, 4), (1_150_000, 12)):
        rows = statements.true_movements(ev(n)).select("statement").withColumn("task", F.spark_partition_id())
        assert rows.groupBy("task").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 2 * -(-n // tasks)
        assert rows.groupBy("statement").agg(F.count_distinct("task").alias("k")).agg(F.max("k")).first()[0] == 1


def test_statement_rows_work_out_movements_once(spark):
    ev = spark.range(2000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 9 AS user_id", "'click' AS event_type", "1.0D AS value")
    rows = statements.statement_rows(ev)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1  # read and sorted once for rows and balances brought forward
    brought = rows.where("event_id IS NULL")
    assert brought.select("row_no", "date", "description", "movement", "printed_side").distinct().collect() == [(0, None, statements.BROUGHT, None, None)]
    want = {(u, p) for u in range(9) for p in range(2, 24, 4) if (u + p) % 17 != 3 and p <= -(-len(range(u, 2000, 9)) // 10)}
    assert {tuple(r) for r in brought.select("statement", "page").collect()} == want and brought.count() == len(want)


def test_amount_filter_derives_the_chain_once(spark, tmp_path):
    folder = str(tmp_path)
    # two users' largest movements are equal, two rows of the other are 1250, of which neither is its statement's largest
    moves = [(0, 1, 5.0), (1, 1, 9000.0), (2, 1, 9000.0), (8, 2, 3.0), (9, 2, 9000.0), (10, 3, 2.0), (12, 3, 1250.0), (13, 3, 1250.0), (14, 3, 1500.0)]
    spark.createDataFrame(moves, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "'click' AS event_type", "value").write.parquet(f"{folder}/events.parquet")
    got = evidence.amount_filter(spark, folder)
    assert "events.parquet" not in "".join(got.inputFiles())
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (2, 2), (3, 2), (3, 3)]

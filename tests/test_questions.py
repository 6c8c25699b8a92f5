from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import questions
from ledgerloom.operators.quantiles import exact_quantiles

WORDS = questions.Vocabulary(own=("our bank",), strong=("northwind",), weak=("fabrikam",))


def scopes(spark, texts, rows=((1, "2024-01-05", "5.00"), (3, "2024-02-01", None)), n_pages=4):
    q = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "question int, statement long, text string")
    r = spark.createDataFrame([(1, p, d, None if a is None else D(a)) for p, d, a in rows], "statement long, page int, iso string, amount decimal(18,2)")
    last = spark.createDataFrame([(1, n_pages)], "statement long, n_pages int")
    return {x.question: (x.scope, x.about) for x in questions.decide_scope(q, r, last, WORDS).collect()}


def test_scope_in_order_of_its_rules(spark):
    cases = {
        "What of Northwind in 1999?": ("other_entity", None),
        "From our bank to Northwind": ("in_scope", None),
        "fabrikam paid": ("in_scope", None),
        "Fabrikam bank paid": ("other_entity", None),
        "northwindy": ("in_scope", None),
        "The phone numbers in 1999": ("personal_data", None),
        "Total of 2024 and 2023": ("year_outside", "2023"),
        "pages 9 and 7": ("page_outside", "7"),
        "pages 1-4": ("page_unread", "2"),
        "page 4": ("page_unread", "4"),
        "Is there a payment of 5.00 on page 3": ("in_scope", None),
        "Is there a payment of 5.00 or 6.00": ("amount_absent", "6.00"),
        "Is there a payment over 6.00": ("in_scope", None),
        "Payments of 6.00": ("in_scope", None),
        None: ("in_scope", None),
        "": ("in_scope", None),
    }
    got = scopes(spark, list(cases))
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_unknown_facts_refuse_nothing(spark):
    texts = ["Total of 1999", "page 70", "Is there a payment of 6.00?"]
    assert set(scopes(spark, texts, rows=(), n_pages=None).values()) == {("in_scope", None)}
    assert scopes(spark, ["page 70"], n_pages=None)[0] == ("page_unread", "70")
    assert scopes(spark, []) == {}


def test_pages_to_fetch(spark):
    q = spark.createDataFrame([(1, 1, "pages 2, 5"), (2, 1, "The CLOSING  balance?"), (3, 1, "closing balance of page 1"), (4, 1, "fees"), (5, 2, "closing balance"), (6, 1, None)], "question int, statement long, text string")
    rows = spark.createDataFrame([(1, 1), (1, 9)], "statement long, page int")
    assert {x.question: x.pages for x in questions.pages_to_fetch(q, rows).collect()} == {1: [2, 5], 2: [9], 3: [1], 4: [], 5: [], 6: []}


def test_what_an_answer_discloses(spark):
    flags = list(questions.NOTICES)
    data = []
    for i in range(16):
        data.append((i, 1, f"answer {i}", *[bool(i >> k & 1) for k in range(4)], False, []))
    data += [(20, 1, "fine", *[None] * 4, None, None), (21, 1, "doubtful", *[None] * 4, True, [3]), (22, 1, None, *[None] * 4, True, []), (23, 1, "typed", *[None] * 4, True, [3])]
    answers = spark.createDataFrame(data, "question int, statement long, answer string, " + ", ".join(f"{f} boolean" for f in flags) + ", typed boolean, cited array<int>")
    used = spark.createDataFrame([(20, 1, 1), (21, 1, 2), (21, 1, 1), (21, 1, 2), (15, 1, 2)], "question int, statement long, page int")
    verdicts = spark.createDataFrame([(1, 1, "ok"), (1, 2, "mismatch")], "statement long, page int, verdict string")
    got = {x.question: x for x in questions.disclosed(answers, used, verdicts).collect()}
    for i in range(16):
        first = next((f for k, f in enumerate(flags) if i >> k & 1), None)
        assert got[i].notice == first and got[i].text.endswith(f"answer {i}") and (first is None) == (got[i].text == f"answer {i}")
        assert got[i].evidence == ("none" if i & 12 else "tools" if i == 15 else "fallback")
    assert (got[20].notice, got[20].evidence, got[20].text) == (None, "tools", "fine")
    assert (got[21].notice, got[21].pages, got[21].evidence, got[21].text) == ("pages", [2], "typed", "doubtful\n\nNot proven: page 2: mismatch")
    assert (got[22].notice, got[22].evidence, got[22].text) == (None, "fallback", "") and got[23].evidence == "typed"


def test_the_log_of_questions(spark):
    asked = spark.createDataFrame([("t1", "q", "a", None, [1, None, 1, 2]), ("t1", "q", "a", None, [3]), ("t1", "q", None, True, []), ("t2", "q", "a", False, None)], "asked_at string, question string, answer string, refused boolean, row_ids array<long>")
    qa, evidence = questions.log_entries(asked)
    entries = {(r.asked_at, r.answer): r for r in qa.collect()}
    assert qa.count() == 3 and entries["t1", None].refused and not entries["t1", "a"].refused
    assert sorted((r.qa_id, r.row_id) for r in evidence.collect()) == [(entries["t1", "a"].qa_id, i) for i in (1, 2, 3)]


def test_quantiles_by_sorting(spark):
    import random

    r = random.Random(5)
    sets = [[r.gauss(0, 1) for _ in range(500)], [float(r.randint(0, 3)) for _ in range(300)], [1e300, -1e300, 0.0, 1e-300, 5.0], [7.0] * 9, [2.5], [10.0**k for k in range(-20, 20)]]
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    for values in sets:
        s, want = sorted(values), []
        for p in shares:
            k = (len(s) - 1) * p
            lo, hi = s[int(k)], s[min(int(k) + (k > int(k)), len(s) - 1)]
            want.append(round(lo + (k - int(k)) * (hi - lo), 6))
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").withColumn("w", F.col("v"))
        assert exact_quantiles(df, ["v", "w"], shares) == {"v": want, "w": want}
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], [0.5]) == {"v": [None]}

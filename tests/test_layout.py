import random
import re
import unicodedata
from decimal import Decimal as D

import pytest

from ledgerloom.functions.visual import in_logical_order, logical_order
from ledgerloom.operators import footers, order
from ledgerloom.sources import boxes

PAGE = "statement long, pos int, debits decimal(18,2), credits decimal(18,2), number int"
ROW = "statement long, pos int, row_no int, description string, movement decimal(18,2), balance decimal(18,2)"


def sheets(spark, totals, numbers=None, moves=None):
    """One statement: cumulative totals by position (None: not read); each page holds one debit of what ``moves`` says."""
    numbers, moves = numbers or {}, moves or {}
    pages = [(1, p, *(D(x) if x is not None else None for x in t), numbers.get(p)) for p, t in totals.items()]
    rows = [(1, p, i, "x", D(m), D(b)) for p, content in moves.items() for i, (m, b) in enumerate(content)]
    decided, ordered = order.decide_order(spark.createDataFrame(pages, PAGE), spark.createDataFrame(rows, ROW))
    return decided.first(), {r.pos: r for r in ordered.collect()}


def test_swapped_sheets_with_arithmetic_witness(spark):
    # true order 1, 3, 2: each sheet takes ten from the balance of the one before
    d, p = sheets(spark, {1: (10, 0), 2: (30, 0), 3: (20, 0)}, moves={1: [(10, 90)], 2: [(10, 70)], 3: [(10, 80)]})
    assert (d.applied, d.reason, d.moved) == (True, None, 1)
    assert [p[i].order for i in (1, 3, 2)] == [1, 2, 3] and p[3].relation == p[2].relation == "adjacent"


def test_lone_move_is_held_and_numbers_may_witness_it(spark):
    totals = {1: (10, 0), 2: (30, 0), 3: (20, 0)}
    d, p = sheets(spark, totals)
    assert (d.applied, d.reason) == (False, "lone") and len(d.lone) == 1 and [p[i].order for i in (1, 2, 3)] == [1, 2, 3]
    d, _ = sheets(spark, totals, numbers={1: 1, 3: 2, 2: 3})
    assert (d.applied, d.reason, list(d.lone)) == (True, None, [])
    d, _ = sheets(spark, totals, numbers={2: 1, 3: 2})
    assert d.reason == "lone"


def test_conflict_and_duplicate_come_first(spark):
    d, _ = sheets(spark, {1: (10, 5), 2: (30, 9), 3: (20, 1)})
    assert (d.applied, d.reason) == (False, "conflict")
    d, _ = sheets(spark, {1: (10, 5), 2: (30, 9), 3: (10, 5)})
    assert (d.applied, d.reason) == (False, "duplicate")


def test_unplaced_sheets_stay_behind_their_file_predecessor(spark):
    d, p = sheets(spark, {1: (None, 3), 2: (40, 0), 3: (None, None), 4: (50, None), 5: (10, 0)})
    assert sorted(p, key=lambda i: p[i].place) == [1, 5, 2, 3, 4] and d.unplaced == 3
    assert {p[i].relation for i in (5, 3, 4)} == {"undecided"} and p[1].relation is None


def test_a_jump_of_numbers_is_a_gap_and_all_else_a_mismatch(spark):
    d, p = sheets(spark, {1: (10, 0), 2: (60, 0), 3: (90, 0)}, numbers={1: 1, 2: 4, 3: 5}, moves={1: [(10, 90)], 2: [(5, 45)], 3: [(5, 40)]})
    assert (p[2].relation, p[3].relation, d.applied, d.reason, d.moved) == ("gap", "mismatch", False, None, 0)
    _, p = sheets(spark, {1: (10, 0), 2: (None, 0)}, numbers={1: 1, 2: 3})
    assert p[2].relation == "gap"


def test_fewest_moved_by_blocks_equals_one_long_run(spark):
    r, data, want = random.Random(4), [], {}
    for s in range(30):
        n = r.randint(1, 25)
        perm = list(range(1, n + 1))
        for _ in range(r.randint(0, 4)):
            i, j = r.randrange(n), r.randrange(n)
            perm.insert(j, perm.pop(i))
        data += [(s, f, k + 1) for k, f in enumerate(perm)]
        want |= {(s, f): not keep for f, keep in zip(perm, footers._longest_run(perm))}
    got = order.moved(spark.createDataFrame(data, "statement long, file_place int, place int")).collect()
    assert {(x.statement, x.file_place): x.moved for x in got} == want


def test_sums_of_rows_in_both_orders(spark):
    ordered = spark.createDataFrame([(1, 1, 2, 1, D(5), "a"), (1, 2, 1, 2, None, "b"), (1, 3, 3, 3, D(7), None), (1, None, 4, 4, None, "c"), (1, None, 5, 5, D(8), "d")], "statement long, pos int, place int, file_place int, debits decimal(18,2), said string")
    rows = spark.createDataFrame([(1, 1, 1, "x", D(10), D(90)), (1, 2, 1, "x", D(10), D(80)), (1, 9, 1, "x", D(10), D(70)), (1, None, 1, "x", D(1), D(60))], ROW)
    got = {r.place: r for r in order.own_sums(rows, ordered, {"place": "own", "file_place": "file"}).collect()}
    assert [(got[p].pos, got[p].file_place, got[p].debits, got[p].said) for p in range(1, 6)] == [(2, 2, None, "b"), (1, 1, D(5), "a"), (3, 3, D(7), None), (None, 4, None, "c"), (None, 5, D(8), "d")]
    sums = lambda name: [(got[p][f"{name}_debits"], got[p][f"{name}_credits"]) for p in range(1, 6)]
    assert sums("own") == [(0, 0), (0, 10), (None, None), (None, None), (None, None)]  # page at pos 1 follows a balance of 80
    assert sums("file") == [(10, 0), (0, 0), (None, None), (None, None), (None, None)]


def test_empty_order(spark):
    decided, pages = order.decide_order(spark.createDataFrame([], PAGE), spark.createDataFrame([], ROW))
    assert decided.count() == pages.count() == 0


# words and their places


def loop_lines(words, tolerance=3.0):
    out, now = [], None
    for w in sorted(words):
        if now is None or w[0] - now[0][0] > tolerance:
            now = []
            out.append(now)
        now.append(w)
    return [sorted(line, key=lambda w: (w[1], w[0], w[2])) for line in out]


def loop_rows(pages, layout):
    """pages: page -> words (top, x, text), one statement."""
    rows = []
    for page in sorted(pages):
        waiting = []
        for line in loop_lines(pages[page], layout.tolerance):
            cells = [t for _, x, t in line if x > layout.amounts_from and re.fullmatch(r"-?[\d,]+\.\d{2}", t)]
            dates = [t for _, x, t in line if x < layout.descriptions_from and re.fullmatch(r"\d{4}/\d{2}/\d{2}", t)]
            said = [t for _, x, t in line if x <= layout.amounts_from and not (x < layout.descriptions_from and re.fullmatch(r"\d{4}/\d{2}/\d{2}", t))]
            text = " ".join(t for *_, t in line).strip()
            if len(cells) >= 3:
                debit, credit, balance = (D(c.replace(",", "")) for c in cells[:3])
                rows.append([page, dates[0] if dates else None, credit or debit, balance, in_logical_order(" ".join(waiting + said))[: layout.longest] or None, cells[1] if credit else cells[0], cells[2]])
                waiting = []
            elif not text or text.startswith(layout.skipped) or in_logical_order(text).strip().strip("· ") in layout.headings:
                pass
            elif layout.heading_prefixes and text.startswith(layout.heading_prefixes) and not text.startswith(layout.notes):
                pass
            elif text.startswith(layout.notes) and rows:
                rows[-1][4] = f"{rows[-1][4] or ''} {in_logical_order(text)}"[: layout.longest].strip() or None
            else:
                waiting.append(text)
    return [(r[0], i, *r[1:]) for i, r in enumerate(rows, 1)]


def random_pages(seed):
    r, pages = random.Random(seed), {}
    said = ["shop", "fee", "ﺔﻤﺳﺍ", "ﻹا", "7", "Ref.", "Date", "Notes:", "Time:", "Head", "Total", "·", "é"]
    for page in range(1, 6):
        words, y = [], 0.0
        for _ in range(r.randint(0, 25)):
            y += r.choice([1.5, 2.9, 3.0, 3.1, 9.0])
            if r.random() < 0.5:
                words += [(y + r.choice([0, 1.0, 2.5, 4.0]), 40.0, "2024/01/05")] * r.randint(0, 1)
                words += [(y + r.choice([0, 1.0, 3.5]), x, r.choice(["0.00", "1,250.50", "-3.10", "x"])) for x in (320.0, 400.0, 480.0)]
            words += [(y, float(r.choice([50, 100, 150, 300, 301])), r.choice(said)) for _ in range(r.randint(0, 3))]
        pages[page] = list(set(words))
    return pages


def spark_rows(spark, pages, layout):
    words = spark.createDataFrame([(1, p, *w) for p, ws in pages.items() for w in ws], "statement long, page int, top double, x double, text string")
    return sorted(((r.page, r.row_no, r.date, r.movement, r.balance, r.description, r.raw_movement, r.raw_balance) for r in boxes.rows_of_words(words, layout).collect()), key=lambda x: x[1])


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_a_plain_loop(spark, seed):
    layout = boxes.Layout(longest=30, heading_prefixes=("Total",), headings=frozenset({"Head"}))
    pages = random_pages(seed)
    want = loop_rows(pages, layout)
    assert spark_rows(spark, pages, layout) == want and len(want) > 5


def test_a_drifting_line_is_cut_at_its_first_word(spark):
    words = spark.createDataFrame([(1, 1, t, 10.0 * i, "w") for i, t in enumerate([0.0, 2.0, 3.0, 3.5, 6.4, 6.6])], "statement long, page int, top double, x double, text string")
    assert [r.line for r in boxes.lines(words).orderBy("top").collect()] == [1, 1, 1, 2, 2, 3]


def test_no_words(spark):
    assert spark_rows(spark, {}, boxes.Layout()) == []


# visual order


def test_visual_order_by_characters(spark):
    r = random.Random(6)
    signs = "ﺔﻤﺳﺍﺏﻻ ﻹا12.ab(é)אב٣\t"

    def slow(text):
        out, run = "", ""
        for ch in unicodedata.normalize("NFKC", text) + "\0":
            if ch.isspace() or unicodedata.bidirectional(ch) in ("R", "AL"):
                run = ch + run
            else:
                out, run = out + run.replace("اإل", "الإ").replace("اآل", "الآ") + ch, ""
        return out[:-1]

    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["", None, "ﻝﺎﻔﻗﻹﺍ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.v for x in df.select("i", logical_order("t").alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else slow(t) for t in texts]
    assert in_logical_order("ﻝﺎﻔﻗﻹﺍ") == "الإقفال"


def test_visual_order_twice_gives_the_letters_back():
    for text in ("ﺔﻤﺳﺍ 12 ab", "abc", "אב גד 7"):
        assert in_logical_order(in_logical_order(text)) == unicodedata.normalize("NFKC", text)


def test_words_are_made_and_moved_once(spark):
    words = spark.createDataFrame([(1, 1, 10.0, 40.0, "2024/01/02"), (1, 1, 10.0, 320.0, "1.00")], "statement long, page int, top double, x double, text string")
    plan = boxes.rows_of_words(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1

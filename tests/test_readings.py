import random
import re
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bands, patterns, ranges, shift
from ledgerloom.plans import layout, readings
from ledgerloom.sources import snapshot


def test_ink_runs_by_pixels(spark):
    r, data = random.Random(1), []
    for i in range(60):
        ys = [y for y in range(60) if r.random() < 0.5]
        r.shuffle(ys)
        data.append((i, ys, r.randint(1, 4), r.randint(1, 5)))
    data += [(60, None, 1, 1), (61, [], 1, 1), (62, [7, 7], 1, 1)]
    want = {}
    for i, ys, gap, least in data:
        runs = []
        for y in sorted(set(ys or [])):
            if runs and y - runs[-1][1] <= gap:
                runs[-1][1] = y
            else:
                runs.append([y, y])
        want[i] = [(a, b) for a, b in runs if b - a + 1 >= least]
    for gap in (1, 2, 3, 4):
        for least in (1, 2, 3, 4, 5):
            some = [d[:2] for d in data if d[2:] == (gap, least)]
            df = spark.createDataFrame(some, "i int, ys array<int>")
            assert {x.i: [tuple(v) for v in x.v] for x in df.select("i", bands.ink_runs(F.col("ys"), gap, least).alias("v")).collect()} == {d[0]: want[d[0]] for d in some}


def test_kinds_of_pages_and_orphans(spark):
    band = lambda *tops: [y for t in tops for y in range(t, t + 8)]
    pages = {1: (band(40, 80), band(80), band(38, 80)), 2: (band(40), band(40), band(10, 40)), 3: (band(40), [], band(10, 40)), 4: ([], band(40), band(40)), 5: (band(40, 80), band(40), band(35)), 6: (None, None, None)}
    df = spark.createDataFrame([(1, p, *c) for p, c in pages.items()], "statement long, pos int, balance array<int>, date array<int>, text array<int>")
    got = {r.pos: r for r in bands.page_bands(df).collect()}
    assert [got[p].kind for p in pages] == ["first", "transactions", "summary", "unknown", "transactions", "unknown"]
    assert [(got[p].orphan_top, got[p].orphan_bottom) for p in (1, 2, 3, 5)] == [(None, None), (10, 33), (None, None), (None, None)]


def test_owners_of_orphans(spark):
    kinds = {1: ("first", 3), 2: ("transactions", 5), 3: ("summary", 1), 4: ("transactions", 2), 5: ("transactions", 4)}
    b = spark.createDataFrame([(1, p, k, n, n, 10, 20) for p, (k, n) in kinds.items()], "statement long, pos int, kind string, bands int, dated int, orphan_top int, orphan_bottom int")
    o = spark.createDataFrame([(1, 1, 1, None), (1, 5, 2, "adjacent"), (1, 2, 3, "gap"), (1, 3, 4, "mismatch"), (1, 4, 5, "adjacent")], "statement long, pos int, place int, relation string")
    got = {r.pos: (r.owner_pos, r.owner_band, r.owner) for r in bands.link_orphans(b, o).collect()}
    assert got == {1: (None, None, "missing"), 5: (1, 2, "confirmed"), 2: (None, None, "gap"), 3: (2, 4, "unconfirmed"), 4: (None, None, "missing")}


def test_orphans_and_orders_work_out_movements_a_few_times_and_stay_in_their_task(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(500).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 9 AS user_id", "'click' AS event_type", "1.0D AS value").write.parquet(f"{folder}/events.parquet")
    for query, times in ((readings.orphan_owners, 3), (layout.page_order, 2), (layout.page_order_decision, 2)):
        plan = query(spark, folder)._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("RepartitionByExpression") == times
        assert plan.sparkPlan().toString().count("Join") == 0 and "Python" not in plan.sparkPlan().toString()
        assert plan.executedPlan().toString().count("Exchange") == times  # the events' own, which is one and the same


def test_slipped_rows_by_counters(spark):
    r, vocab = random.Random(2), ["card", "fee", "to", "اسم", "Shop", "x", "12", "إلى"]
    fold = str.maketrans("آأؤإئةىٱ", "ااوايهيا")
    bag = lambda t: Counter(re.findall("[a-z]{2,}|[ء-ي]{2,}", re.sub("[ً-ْٰـ]", "", t.lower()).translate(fold)))
    sim = lambda a, b: sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0
    data, want = [], {}
    for page in range(40):
        n = r.randint(1, 7)
        refs = [" ".join(r.choices(vocab, k=r.randint(0, 4))) if r.random() < 0.85 else None for _ in range(n)]
        texts = [refs[max(0, i - 1)] or "" if page % 3 == 0 and i > 1 else (refs[i] or "") + r.choice(["", " to", " card fee to"]) for i in range(n)]
        data += [(1, page, i, t, ref) for i, (t, ref) in enumerate(zip(texts, refs))]
        runs, best = 0, 0
        for i, ref in enumerate(refs):
            near = max([sim(bag(texts[i]), bag(refs[j])) for j in (i - 1, i + 1) if 0 <= j < n and refs[j] is not None] or [0.0])
            runs = runs + 1 if ref is not None and near > sim(bag(texts[i]), bag(ref)) + 0.3 else 0
            best = max(best, runs)
        kinds = Counter()
        for t, ref in zip(texts, refs):
            if ref is not None:
                a, b = bag(t), bag(ref)
                kinds["same" if a == b else "one_side_extra" if not (a - b and b - a) else "small" if sum((a - b).values()) + sum((b - a).values()) <= 2 else "big"] += 1
        want[page] = (sum(x is not None for x in refs), kinds["same"], kinds["one_side_extra"], kinds["small"], kinds["big"], best, best >= 2)
    df = spark.createDataFrame(data, "statement long, page int, n int, text string, reference string")
    assert {x.page: tuple(x)[2:] for x in shift.shifted_pages(df).collect()} == want
    assert any(w[-1] for w in want.values())


def test_patterns_by_search(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab cé") for _ in range(r.randint(0, 30))) for _ in range(80)] + ["", None]
    asked = [(i, "".join(r.choice("ab cé") for _ in range(r.randint(1, 7)))) for i in range(60)] + [(100, ""), (101, None), (102, "zzz"), (103, "ab"), (103, "ab")]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    p = spark.createDataFrame(asked, "question int, pattern string")
    hits = patterns.rows_with_patterns(p, rows)
    want = {(q, x, k) for q, x in asked if x for k, t in enumerate(texts) if t and x in t}
    assert {(h.question, h.pattern, h.k) for h in hits.collect()} == want and hits.count() == len(want)
    n = Counter((q, x) for q, x, _ in want)
    got = {(a.question, a.pattern): (a.hits, a.scanned, a.status) for a in patterns.absence(p, hits, rows).collect()}
    assert got == {(q, x): (n[q, x], len(texts), ["absent", "single", "several"][min(2, n[q, x])]) for q, x in asked}
    none = patterns.rows_with_patterns(p, rows.limit(0))
    assert none.count() == 0 and {a.status for a in patterns.absence(p, none, rows.limit(0)).collect()} == {"absent"}


def test_hits_that_no_row_of_the_chain_stands_for(spark):
    hits = spark.createDataFrame([(1, "fee", 1, 1, 1, D(5)), (1, "fee", 1, 1, 2, D(5)), (1, "fee", 1, 1, 3, None), (1, "fee", 1, 2, 1, D(5))], "question int, pattern string, statement long, page int, n int, balance decimal(18,2)")
    chain = spark.createDataFrame([(1, 1, 10, "a fee"), (1, 1, 11, "other")], "statement long, page int, seq int, text string")
    assert sorted((r.page, r.n, r.seq, r.why) for r in patterns.citable(hits, chain).collect()) == [(1, 1, 10, None), (1, 2, None, "shifted"), (1, 3, None, "unread balance"), (2, 1, None, "beyond")]


def test_questions_of_one_pattern_are_dealt_out_behind_all_shuffles(spark):
    rows = spark.createDataFrame([(1, 1, n, D(5) if n % 3 else None, f"fee {n}") for n in range(1, 13)], "statement long, page int, n int, balance decimal(18,2), text string")
    chain = spark.createDataFrame([(1, 1, 10 + n, f"fee {n}") for n in range(1, 9)], "statement long, page int, seq int, text string")
    asked = spark.createDataFrame([(q, "fee") for q in range(500)] + [(500, "fee 7"), (501, "fee 12"), (502, "no fee at all, nowhere"), (503, ""), (504, None), (500, "fee 7")], "question int, pattern string")
    before_questions = patterns.judged(patterns.hits_of(patterns.by_pattern(asked), patterns.standing(rows, chain)))
    assert before_questions.count() <= 12 * patterns.LISTS + 2
    got = sorted(map(repr, patterns.citations(asked, rows, chain).collect()))
    assert got == sorted(map(repr, patterns.citable(patterns.rows_with_patterns(asked, rows), chain).collect())) and len(got) == 12 * 500 + 2


def test_rows_of_a_frequent_pattern_are_dealt_to_several_tasks(spark):
    rows = spark.createDataFrame([(n, f"fee {n} fee {n}") for n in range(400)], "k int, text string")
    asked = spark.createDataFrame([(q, "fee") for q in range(600)] + [(600, "fee 7"), (None, "fee"), (601, "")], "question int, pattern string")
    lists = patterns.by_pattern(asked)
    assert sorted(len(r.asking) for r in lists.where("pattern = 'fee 7'").collect()) == [1] and lists.count() <= 1 + -(-601 // patterns.LENGTH)
    hits = patterns.hits_of(lists, rows).where("pattern = 'fee'")
    tasks = Counter(r.task for r in hits.select(F.spark_partition_id().alias("task")).collect())
    assert len(tasks) > 1 and max(tasks.values()) < 0.7 * sum(tasks.values())
    got = Counter((r.question, r.pattern, r.k) for r in patterns.rows_with_patterns(asked, rows).collect())
    assert got == Counter([(q, "fee", n) for q in [*range(600), None] for n in range(400)] + [(600, "fee 7", n) for n in range(400) if str(n).startswith("7")])
    assert patterns.rows_with_patterns(asked.where("pattern = ''"), rows).count() == 0


def test_pages_read_once_stand_as_rows_beside_their_chain(spark):
    r = random.Random(6)
    data = [(s, 1 + k // 7, k, D(k) if r.random() < 0.7 else None, f"fee {s} {k}") for s in range(9) for k in range(30)]
    read = spark.createDataFrame(data, "statement long, page int, seq int, balance decimal(18,2), text string")
    at = Counter()
    rows = []
    for s, p, _, b, t in data:
        at[s, p] += 1
        rows.append((s, p, at[s, p], b, t))
    chain = read.where("balance IS NOT NULL").select("statement", "page", "seq", "text")
    two = patterns.standing(spark.createDataFrame(rows, "statement long, page int, n int, balance decimal(18,2), text string"), chain)
    assert sorted(map(repr, two.collect())) == sorted(map(repr, patterns.standing_read(read).select(*two.columns).collect()))


def test_absence_from_hits_of_patterns_alone(spark):
    rows = spark.createDataFrame([("a fee",), ("two fees",), (None,)], "text string")
    asked = spark.createDataFrame([(q, "fee") for q in range(40)] + [(40, "two"), (41, "three"), (42, ""), (43, None), (40, "two")], "question int, pattern string")
    hits = patterns.hits_of(asked.select("pattern").distinct(), rows)
    assert hits.count() == 3  # not one for each question
    got = {r.question: (r.hits, r.scanned, r.status) for r in patterns.absence(asked, hits, rows).collect()}
    assert got == {q: (2, 3, "several") for q in range(40)} | {40: (1, 3, "single"), 41: (0, 3, "absent"), 42: (0, 3, "absent"), 43: (0, 3, "absent")}


def test_ranges_by_scanning(spark):
    r, data, want = random.Random(4), [], {}
    for s in range(40):
        length = 3
        pages = {p: (r.random() < 0.15, r.random() < 0.1, r.random() < 0.85) for p in range(1, r.randint(3, 40)) if r.random() < 0.95}
        data += [(s, p, *v) for p, v in pages.items()]
        free = [p for p in sorted(pages) if not pages[p][0] and not pages[p][1]]
        q = len(free) // 3
        for k, part in enumerate((free[:q], free[q : 2 * q], free[2 * q :]), 1):
            if not part:
                continue
            fits = [p for p in part if p + length - 1 <= part[-1] and all(x in pages and not pages[x][0] and pages[x][2] for x in range(p, p + length)) and (p == 1 or (p - 1 in pages and pages[p - 1][2]))]
            best = run = 0
            for i, p in enumerate(part):
                run = run + 1 if i and part[i - 1] == p - 1 else 1
                best = max(best, run)
            widest = max((sum(x in part for x in range(a, a + length)) for a in range(part[0], part[-1] - length + 2)), default=None)
            want[s, k] = (len(part), best, fits[0] if fits else None, None if fits or widest is None else length - widest)
    df = spark.createDataFrame(data, "statement long, page int, excluded boolean, passage boolean, framed boolean")
    assert {(x.statement, x.third): tuple(x)[2:] for x in ranges.choose_ranges(df, 3).collect()} == want


def test_a_snapshot_is_held_against_its_digest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", D("1.50")), (2, None, None), (3, "", D("7.00"))], "seq int, text string, amount decimal(18,2)")
    pages = spark.createDataFrame([(1, "ok")], "page int, verdict string")
    path = f"{tmp_path}/snap"
    snapshot.save({"rows": rows, "pages": pages}, path, "sha-1")
    back = snapshot.load(spark, path, "sha-1")
    assert sorted(map(tuple, back["rows"].collect())) == sorted(map(tuple, rows.collect())) and back["pages"].count() == 1
    with pytest.raises(snapshot.SnapshotMismatch, match="another file"):
        snapshot.load(spark, path, "sha-2")
    d = lambda *data: snapshot.digest(spark.createDataFrame(list(data), "seq int, text string")).first().digest
    base = d((1, "a"), (2, "b"))
    assert base == d((2, "b"), (1, "a")) and base == snapshot.digest(spark.createDataFrame([("b", 2), ("a", 1)], "text string, seq int")).first().digest
    assert len({base, d((1, "a"), (2, "c")), d((1, "a")), d((1, "b"), (2, "a")), d((1, "a"), (2, "b"), (2, "b")), d((1, "a"), (2, None)), d((1, "a"), (2, "")), d((1, "a"), (None, "b"))}) == 8
    for changed in (rows.where("seq < 3"), rows.unionByName(rows.where("seq = 1")), rows.withColumn("text", F.when(F.col("seq") == 1, "b").otherwise(F.col("text"))), rows.withColumn("text", F.when(F.col("seq") == 1, None).when(F.col("seq") == 2, "a").otherwise(F.col("text")))):
        changed.write.mode("overwrite").parquet(f"{path}/rows")
        with pytest.raises(snapshot.SnapshotMismatch, match="rows"):
            snapshot.load(spark, path, "sha-1")


def test_an_empty_snapshot(spark, tmp_path):
    snapshot.save({"rows": spark.createDataFrame([], "seq int")}, f"{tmp_path}/none", "s")
    assert snapshot.load(spark, f"{tmp_path}/none", "s")["rows"].count() == 0

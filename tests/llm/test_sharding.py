import hashlib
import random

from ledgerloom.llm import sharding


def brute(rows, shards=8, keep=0.04):
    """(doc_id, text) -> shard, slot of the definition, by one ordered pass."""
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(rows, key=lambda r: (key(r[1]), -(2**63) if r[0] is None else r[0]))
    whole, at, begins, groups = sum(size(t) for _, t in rows), 0, [], {}
    for d, t in order:
        begins.append(at)
        g = groups.setdefault(key(t), [at, at])
        at += size(t)
        g[1] = at
    cuts = []
    for i in range(1, shards):
        target = i * whole // shards
        a, b = next((a, b) for a, b in groups.values() if a <= target < b)
        cuts.append(target if b - a > keep * whole / shards else a if target - a <= b - target else b)
    out, slots = [], [0] * shards
    for (d, t), start in zip(order, begins, strict=True):
        s = sum(start >= c for c in cuts)
        out.append((d, t, s, slots[s]))
        slots[s] += 1
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS shard", "2 AS other")
    out = sharding.histogram_shards(docs, **more)
    assert set(out.columns) == {"doc_id", "text", "other", "size", "shard", "slot"}
    return sorted(((r.doc_id, r.text, r.shard, r.slot) for r in out.collect()), key=str)


def test_brute_force_with_a_frequent_text(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(r.randint(0, 60)))) for i in range(500)]
    rows += [(1000 + i, "the same text") for i in range(400)] + [(3000, None), (3001, ""), (None, "x" * 2000), (3002, "y" * 5000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, rows_per_run=20) == brute(rows)


def test_several_frequent_texts(spark, monkeypatch):
    """Two in one run, one over several borders, ids far apart; each is cut."""
    monkeypatch.setattr(sharding, "PARTS", 8)
    r = random.Random(6)
    rows = [(r.randrange(10**6), f"t{i}") for i in range(100)] + [(r.randrange(100), "often") for _ in range(300)] + [(10**15, "often")]
    rows += [(r.randrange(-(10**9), 10**9), "as often") for _ in range(300)] + [(i, "most of all, by far " * 3) for i in range(900)]
    rows = list({(d, t) for d, t in rows})
    assert run(spark, rows, rows_per_run=25) == brute(rows)
    assert run(spark, rows, rows_per_run=250) == brute(rows)
    assert len({s for _, t, s, _ in run(spark, rows) if t.startswith("most")}) > 2


def test_small_groups_stay_together_and_sizes_are_near(spark):
    rows = [(i, f"text {i // 2} " + "w" * 50) for i in range(4000)]
    got = run(spark, rows)
    home = {}
    for _, t, s, _ in got:
        home.setdefault(t, set()).add(s)
    assert all(len(s) == 1 for s in home.values())
    sizes = [sum(len(t) + 1 for _, t, x, _ in got if x == s) for s in range(8)]
    assert max(sizes) < 1.05 * min(sizes)


def test_edge_tables(spark):
    assert run(spark, []) == []
    assert [x[3] for x in run(spark, [(1, "same"), (1, "same")])] == [0, 1]
    assert run(spark, [(1, None)]) == brute([(1, None)])

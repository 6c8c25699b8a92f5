import math
import random

import numpy as np
import pytest

from ledgerloom.llm import maxscore


def brute(rows, every, k):
    ok = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = []
        for own in {tuple(v) for i, v in ok if i == q}:
            best += [(-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=5, **more):
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS score"))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.search(v.where(f"vec_id % {every} = 0"), v, k, **more).collect())


def test_brute_force_with_ties_and_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(12)]) for i in range(150)] + [(200 + i, [0.5] * 12) for i in range(60)]
    rows += [(300, None), (301, [None] + [0.1] * 11), (305, [float("nan")] * 12), (310, [float("inf")] * 12), (None, [0.1] * 12), (7, [0.9] * 12), (7, [0.9] * 12)]
    assert run(spark, rows, shard_rows=40, block_rows=8) == brute(rows, 5, 5)
    assert run(spark, rows) == brute(rows, 5, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i * 20003 + j) for j in range(4)]) for i in range(20)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_components_beyond_two_to_the_27_after_scaling(spark):
    rows = [(0, [1e6, 0.0]), (1, [1.0, 1.0]), (2, [1e6, -3.0]), (3, [2.0**24, 1.0]), (4, [0.5, -(2.0**30)])]
    assert run(spark, rows) == brute(rows, 5, 5)
    big = [(0, [2.0**22] * 3), (1, [2.0**21] * 3), (2, [-(2.0**22)] * 3)]  # partial sums of Python's integers
    assert run(spark, big) == brute(big, 5, 5)
    for bad in ([(0, [1e300]), (1, [1.0])], [(0, [2.0**40] * 2), (1, [2.0**40] * 2)]):
        with pytest.raises(Exception, match="too large|OverflowError"):
            run(spark, bad)


def test_a_shard_by_plain_products():
    r = np.random.default_rng(4)
    for n, d, k in ((1, 3, 5), (7, 20, 5), (500, 33, 5), (2000, 64, 1)):
        x, ids = r.integers(-200, 300, (n, d)), r.permutation(n) * 3
        q, q_ids = r.integers(-200, 300, (20, d)), np.arange(20)
        got = maxscore.best_of_shard(q, q_ids, x, ids, k)
        want = [(int(i), v, s) for i, row in zip(q_ids, q, strict=True) for s, v in sorted(((int(a @ row), int(j)) for a, j in zip(x, ids, strict=True) if j != i), key=lambda t: (-t[0], t[1]))[:k]]
        assert got == want


def test_few_candidates_and_empty_table(spark):
    assert run(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -65536)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []

import random

import numpy as np

from ledgerloom.llm import near_dedup as nd

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    w = [x for x in (text or "").translate(UP).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [(d, sets(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(sets(t)), None if d is None else find(d), d is None or find(d) == d) for d, t in rows), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'z' AS kept", "2 AS key")
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()), key=str)


def test_brute_force_over_near_copies(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeéX") for _ in range(r.randint(1, 6)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append((n, r.choice([" ", "\n", "\t "]).join(copy)))
            n += 1
    passage = [word() for _ in range(60)]
    rows += [(n + i, " ".join(passage + [word() for _ in range(r.choice([8, 15, 40]))])) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[5][1].upper()), (904, rows[5][1]), (904, rows[5][1]), (None, rows[5][1]), (905, "one two"), (906, "ONE\x0btwo"), (907, "x\xa0y " * 3000)]
    assert run(spark, rows) == brute(rows)


def test_frequent_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    """Hubs of many copies, a frequent shingle that stands early in texts that aren't linked, repeated rows."""
    monkeypatch.setattr(nd, "HOT", 4)
    monkeypatch.setattr(nd, "PIECES", 3)
    r = random.Random(10)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: r.randint(0, 3)], f"x{i}", *base[5:]])) for i in range(40)]
    lines = [" ".join(f"l{k}w{j}" for j in range(9)) for k in range(6)]
    rows += [(100 + i, " ".join(r.sample(lines, 3))) for i in range(40)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (200, rows[0][1])]
    assert run(spark, rows) == brute(rows)


def test_different_words_of_a_regular_form_are_not_linked(spark):
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    one, other = "a", "b"
    for _ in range(12):
        one, other = one + other, other + one
    rows = [(1, one), (2, other), (3, one)]
    assert run(spark, rows) == brute(rows) == sorted([(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)], key=str)


def test_planted_pairs_are_found(spark):
    """Pairs of similarity just at and above 0.75: at least 0.9 of them; here all."""
    rows, n = [], 0
    for i in range(150):
        size = 40 + i
        base = [f"p{i}w{j}" for j in range(size)]
        cut = (size - 4) // 7
        rows += [(n, " ".join(base)), (n + 1, " ".join(base[cut:] + [f"p{i}v{j}" for j in range(cut)]))]
        n += 2
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(not kept for *_, kept in got) >= 0.9 * sum(not kept for *_, kept in brute(rows)) > 50


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {c for _, _, c, _ in got} == {0}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (3000, 500, 500))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    assert (nd.merge(nd.sketch(x), nd.sketch(y)) == nd.sketch(np.union1d(x, y))).all()
    got = nd.likely_similarity(nd.sketch(x)[None], nd.sketch(y)[None], np.array([3500]), np.array([3500]))[0]
    assert abs(got - 0.75) < 0.1


def test_registers_agree_as_often_as_sets():
    r = np.random.default_rng(2)
    rates = []
    for _ in range(60):
        common, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (60, 10, 10))
        rates.append((nd.sketch(np.concatenate([common, a])) == nd.sketch(np.concatenate([common, b]))).mean())
    assert abs(np.mean(rates) - 0.75) < 0.02

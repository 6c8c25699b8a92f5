import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import prefix_trie


def sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs, span=5, heads=9):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = convs.get(c - int(c % span if c >= 0 else -(-c % span)), [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[:-1] == q for r in nodes)
        ended = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, most, heads=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "'x' AS turns", "2 AS n", "3 AS key")
    convs = prefix_trie.packed(df)
    convs = prefix_trie.with_shared_heads(convs) if heads else convs
    return sorted((tuple(r) for r in prefix_trie.trie(convs, most).collect()), key=str)


def corpus(seed):
    r, rows = random.Random(seed), []
    for c in range(-3, 45):
        said = [(r.choice(["user", "assistant"]), r.choice(["hi", "é ü", "", "what"])) for _ in range(r.randint(1, 6))]
        if c % 3 == 0:  # a third begins alike
            said = [("user", "hello"), ("assistant", "yes?")] + said[:3]
        if c % 4 == 1:  # copies
            said = [("user", "hello"), ("assistant", "no")]
        rows += [(c, t if t or c % 2 else None, *x) for t, x in enumerate(said)]
    rows += [(60, 1, None, None), (60, 2, "user", None), (61, 1, "", ""), (None, 1, "user", "lost"), (62, 5, "use", "rx"), (63, 5, "user", "x"), (64, 1, "user", "é" * 5000)]
    rows += [(65, t, "user", str(t % 2)) for t in range(40)] + [(66, t, "user", str(t % 2)) for t in range(39)]  # a long shared chain
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1, 6, 40, 100_000])
def test_brute_force_at_every_size_of_share(spark, most):
    rows = corpus(most)
    assert run(spark, rows, most) == brute(sequences(rows))


@pytest.mark.parametrize("most", [3, 100_000])
def test_shared_heads(spark, most):
    rows = corpus(9)
    assert run(spark, rows, most, heads=True) == brute(rebuilt(sequences(rows)))


def test_rows_of_equal_turn_stand_by_role_and_text(spark):
    rows = [(1, 3, "b", "x"), (1, 3, "a", "z"), (1, 3, "a", "y"), (1, 3, "a", "y")]
    assert run(spark, rows, 10) == brute(sequences(rows))


def test_empty_tables(spark):
    assert run(spark, [], 10) == run(spark, [(None, 1, "user", "x")], 10) == []
    df = spark.createDataFrame([(7, None), (3, b"")], "conv_id long, turns binary")
    assert [tuple(r)[:7] for r in prefix_trie.trie(df).collect()] == [(3, 0, None, 2, 0, 1, 0)]


def test_many_copies_are_hashed_as_they_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(1000)]
    assert run(spark, rows, 10) == brute(sequences(rows))

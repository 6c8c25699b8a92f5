import hashlib
import math
import random
import re
import zlib
from collections import Counter

from ledgerloom.llm import importance

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def feats(t, longest):
    w = SPLIT.findall((t or "").translate(UP))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, longest, buckets, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x, longest)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        w, f = feats(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in f)
        rows.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, percent=10, least=5, longest=1, buckets=50, seed=7):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1L AS weight", "'x' AS print", "array(1) AS buckets", "0 AS rank")
    t = spark.createDataFrame([(x,) for x in target], "text string").selectExpr("*", "2 AS n")
    return sorted((tuple(r) for r in importance.resample(d, t, percent, least, longest, buckets, seed).collect()), key=str)


def corpus():
    r = random.Random(3)
    vocab = ["Éa", "the", "THE", "of", "x1", "straße", "ΑΣ", "k", "data", "sum"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "."]) for _ in range(n))
    docs = [(i, text(r.randint(0, 30))) for i in range(60)]
    docs += [(100 + i, docs[3][1] + " the of k data x1") for i in range(30)]  # copies
    docs += [(None, text(9)), (None, text(9)), (200, None), (201, ""), (202, " ., "), (203, text(4000)), (5, text(8)), (5, text(8))]
    return docs, [text(12) for _ in range(8)] + [None, ""]


def test_brute_force(spark):
    docs, target = corpus()
    for longest in (1, 2, 3):
        assert run(spark, docs, target, 30, 5, longest) == brute(docs, target, 30, 5, longest, 50, 7)


def test_equal_rows_get_different_ranks(spark):
    docs = [(1, "a b c d e f")] * 4 + [(2, "a b c d e g")] * 2
    assert sorted(r[5] for r in run(spark, docs, ["a"], 100)) == [1, 2, 3, 4, 5, 6]


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    docs, _ = corpus()
    assert run(spark, docs, [], 50) == brute(docs, [], 50, 5, 1, 50, 7)
    assert [r[5] for r in run(spark, [(1, "too few")], ["a"], 100)] == [None]


def test_ranks_over_many_ranges(spark):
    docs = [(i, f"a b c d e w{i % 97}") for i in range(3000)]
    out = run(spark, docs, ["w1 w2"], 100)
    assert out == brute(docs, ["w1 w2"], 100, 5, 1, 50, 7) and {r[5] for r in out} == set(range(1, 3001))

import random
import re

from ledgerloom.llm import decontam

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return SPLIT.findall((t or "").translate(UP))


def brute(docs, items, n=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            v = words(it)
            if not v or i is None:
                continue
            for a in range(max(1, len(v) - n + 1)):
                g = v[a : a + n]
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit.update(range(k, k + len(g)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'x' AS h", "'y' AS window")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontam.contamination(d, i).collect()), key=str)


def test_brute_force(spark):
    r = random.Random(1)
    vocab = ["Éa", "ouatwh", "the", "THE", "of", "x1", "straße", "İz", "ΑΣ", "k"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(12)] + [(90, None), (91, ""), (92, " .,"), (None, "the of"), (1, text(12)), (93, "ΑΣ the k")]
    docs = [(i, text(r.randint(0, 40))) for i in range(40)]
    docs += [(100 + i, text(5) + " " + (t or "").upper() + "; " + text(4) + " " + (t or "")) for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, docs[41][1]), (202, docs[41][1]), (None, docs[42][1]), (203, "ΑΣ'the K " + text(3000))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]


def test_overlapping_windows_count_once(spark):
    w = " ".join(f"w{i}" for i in range(13))
    assert run(spark, [(1, f"zz {w} zz {w}")], [(7, w), (8, w)]) == [(1, 28, 26, ["7", "8"])]

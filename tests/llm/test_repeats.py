import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from ledgerloom.llm import repeats


def brute(docs, n):
    """docs: (doc_id, text); rows equal in both are one document; of one id the order is that of the key of the text."""
    key = lambda d, b: (-(2**63) if d is None else d, repeats._text_key(b, True))
    texts = {key(d, (x or "").encode()): (x or "").encode() for d, x in docs}
    first, gone = {}, {}
    for k in sorted(texts):
        b, gone[k] = texts[k], set()
        for i in range(len(b) - n + 1):
            if first.setdefault(b[i : i + n], (k, i)) != (k, i):
                gone[k].update(range(i, i + n))
    out = []
    for d, x in docs:
        b = (x or "").encode()
        g = gone[key(d, b)]
        spans = [i for i in sorted(g) if i - 1 not in g]
        out.append((d, len(b), len(g), len(spans), bytes(c for i, c in enumerate(b) if i not in g)))
    return sorted(out, key=str)


def run(spark, docs, n):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS d", "'x' AS t", "2 AS spans", "3 AS body")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, n).collect()), key=str)


def in_tasks(tasks, n, told_apart=True, bits=3):
    """The passes without Spark: ``tasks`` are lists of (d, bytes), each sorted by itself."""
    every = [x for task in tasks for x in task]

    def exchange(run, batches):
        rows = [r for b in batches for out in run(iter([b])) for r in out.to_pylist()]
        return pd.DataFrame(rows, columns=["bucket", "kind", "data"])

    def buckets(rows, windows):
        step = repeats._bucket_pass(n, windows)
        parts = [step(p.reset_index(drop=True)) for _, p in rows.groupby("bucket")]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["d", "t", "lo", "hi", "open"])

    found = buckets(exchange(repeats._first_pass(n, bits, told_apart), [pa.RecordBatch.from_pydict({"d": [d for d, _ in t], "text": pa.array([b for _, b in t], pa.binary())}) for t in tasks]), False)
    still = found[found["open"].astype(bool)]
    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    batches = []
    for d, b in every:
        t = repeats._text_key(b, told_apart)
        mine = still[(still["d"] == d) & (still["t"] == t)]
        if len(mine):
            batches.append(pa.RecordBatch.from_pydict({"d": [d], "t": [t], "body": [zstandard.compress(b)], "spans": pa.array([[{"lo": lo, "hi": hi} for lo, hi in zip(mine["lo"], mine["hi"])]], spans)}))
    lost = pd.concat([found[~found["open"].astype(bool)], buckets(exchange(repeats._window_pass(n, bits), batches), True)])
    out = []
    for d, b in every:
        mine = lost[(lost["d"] == d) & (lost["t"] == repeats._text_key(b, told_apart))]
        g = {i for lo, hi in zip(mine["lo"], mine["hi"]) for i in range(lo, hi)}
        out.append((d, len(b), len(g), sum(i - 1 not in g for i in g), bytes(c for i, c in enumerate(b) if i not in g)))
    return sorted(out, key=str)


def corpus(seed, alphabet, size):
    r = random.Random(seed)
    text = lambda m: "".join(r.choice(alphabet) for _ in range(m))
    shared = [text(r.randint(5, 60)) for _ in range(6)]
    docs = [(i, text(r.randint(0, size)) + r.choice(shared) + text(r.randint(0, size)) + r.choice(shared)[: r.randint(0, 50)]) for i in range(40)]
    docs += [(100 + i, docs[7][1]) for i in range(8)] + [(200, "ab" * 120), (201, "z" * 300), (202, "z" * 41), (203, None), (204, "")]
    docs += [(None, docs[3][1]), (None, text(30)), (5, text(60)), (5, docs[5][1]), (9, docs[9][1]), (9, docs[9][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("n", [2, 7, 20])
def test_brute_force(spark, n):
    docs = corpus(n, "abé", 40)
    assert run(spark, docs, n) == brute(docs, n)


def test_passages_of_prose(spark):
    r = random.Random(5)
    words = ["the", "of", "data", "Straße", "né", "sum", "are", "over", "lines", "row"]
    prose = lambda m: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(m))
    passage = prose(60)
    docs = [(i, f"{prose(r.randint(0, 80))} {passage if i % 3 == 0 else ''} {prose(20)} {passage[50:220] if i % 5 == 0 else ''}") for i in range(40)]
    out = run(spark, docs, 100)
    assert out == brute(docs, 100)
    assert sum(x[2] > 0 for x in out) >= 15 and any(x[2] == 0 for x in out)


@pytest.mark.parametrize("chunk", [64, 256])
def test_long_texts_in_steps_and_many_batches(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 500)
    monkeypatch.setattr(repeats, "BATCH_WINDOWS", 30)
    monkeypatch.setattr(repeats, "PASS_ROWS", 3)
    repeats._tables.cache_clear()
    try:
        for seed in range(3):
            docs = list({(d or 0, (x or "").encode()) for d, x in corpus(seed, "abc", 200)})
            tasks = [docs[i::5] for i in range(5)]
            assert in_tasks(tasks, 12) == brute([(d, b.decode()) for d, b in docs], 12)
    finally:
        repeats._tables.cache_clear()


def test_anchors_follow_from_the_window_alone():
    r = np.random.default_rng(1)
    n, lengths = 20, np.array([300, 5, 20, 21, 400])
    buf = r.integers(97, 100, lengths.sum()).astype(np.uint8)
    lo, hi, g = repeats.anchors(buf, lengths, n)
    ends, seen, of = np.cumsum(lengths), [], {}
    for a, b, x in zip(lo, hi, g):
        seen += range(a, b + 1)
        for i in range(a, b + 1):
            assert of.setdefault(buf[i : i + n].tobytes(), x) == x
    assert seen == [i for e, m in zip(ends, lengths) for i in range(e - m, e - n + 1)]


def test_a_text_longer_than_a_step(spark):
    r = random.Random(2)
    base = "".join(r.choice("abcdefgh ") for _ in range(1_400_000))
    docs = [(1, base), (2, "x" * 50 + base[1_000_000:1_200_000] + "y"), (3, base[:99])]
    out = {x[0]: x for x in run(spark, docs, 100)}
    assert out[1][2:4] == (0, 0) and out[2][2:] == (200_000, 1, b"x" * 50 + b"y") and out[3][2] == 0


def test_empty_tables(spark):
    assert run(spark, [], 100) == []
    assert run(spark, [(1, None), (None, "")], 100) == [(1, 0, 0, 0, b""), (None, 0, 0, 0, b"")]
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 1)

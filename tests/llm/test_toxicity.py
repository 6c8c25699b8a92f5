import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity as t
from ledgerloom.llm.queries import op3_toxicity


def corpus(n=600, seed=3):
    r = random.Random(seed)
    clean = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["scumble", "idiotic", "trashy"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op3_toxicity(spark, str(tmp_path)).collect()}
    held = [(got[i].predicted, x) for i, _, x in rows if got[i].held_out]
    assert 80 < len(held) < 160
    assert np.mean([p == x for p, x in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_risk_and_step_by_brute_force():
    """The non-negative risk as a plain double loop; its direction by differences."""
    r = np.random.default_rng(3)
    for prior, shift in ((0.1, 0.0), (0.6, -6.0), (0.3, 2.0)):
        z, is_p = r.normal(size=12) + shift * (np.arange(12) >= 5), np.arange(12) < 5
        plus = sum(np.log(1 + np.exp(-x)) for x in z[is_p]) / 5
        negative = sum(np.log(1 + np.exp(x)) for x in z[~is_p]) / 7 - prior * sum(np.log(1 + np.exp(x)) for x in z[is_p]) / 5
        got, step = t.risk(z, is_p, prior)
        assert abs(got - (prior * plus + max(0, negative))) < 1e-12
        followed = (lambda y: t.risk(y, is_p, prior)[0]) if negative >= 0 else (lambda y: -(np.logaddexp(0, y[~is_p]).mean() - prior * np.logaddexp(0, y[is_p]).mean()))
        for i in range(12):
            up, down = z.copy(), z.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert abs((followed(up) - followed(down)) / 2e-6 - step[i]) < 1e-6
        assert (negative < 0) == (prior == 0.6)


def test_a_repeated_id_stays_one_text_of_the_fit(spark, monkeypatch):
    monkeypatch.setattr(t, "POSITIVES", 2)
    monkeypatch.setattr(t, "UNLABELLED", 3)
    docs = spark.createDataFrame([(1, f"bad {i}") for i in range(50)] + [(2, "good"), (3, "fine")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(t, "train", lambda p, u, prior: seen.append((len(p), len(u))))
    t.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert seen == [(1, 3)]


def test_unlabelled_positives_do_not_spoil_it(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("found"))
    some = spark.createDataFrame([(i, x if i % 2 else None) for i, _, x in rows], "doc_id long, toxic int")
    model = t.fit(docs, some)
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(x) for i, _, x in rows]) > 0.95


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 50_000), (3, "y")], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 1), (1, 0), (None, 1)]):
        model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = t.score(docs, model).collect()
        assert len(got) == 5
        assert all(0 <= r.score <= 1 for r in got)
    assert t.score(docs.limit(0), model).count() == 0

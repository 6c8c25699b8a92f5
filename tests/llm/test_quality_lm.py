import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import quality_lm as q


def brute_model(texts, order):
    """p(byte | context) of interpolated modified Kneser-Ney, by dictionaries."""
    pad = b"\n" * (order - 1)
    level = {order: Counter()}
    for t in texts:
        raw = pad + (t or "").encode() + b"\n"
        for i in range(len(raw) - order + 1):
            level[order][raw[i : i + order]] += 1
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    discount, by_context = {}, {}
    for n in level:
        c = Counter(level[n].values())
        y = c[1] / max(1, c[1] + 2 * c[2])
        discount[n] = [0] + [min(max(i - (i + 1) * y * c[i + 1] / max(1, c[i]), 0.05), i - 0.05) for i in (1, 2, 3)]
        by_context[n] = defaultdict(list)
        for g, k in level[n].items():
            by_context[n][g[:-1]].append(k)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        seen = by_context[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d = lambda k: discount[n][min(k, 3)]
        k = level[n].get(gram, 0)
        return (k - d(k) if k else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * p(gram[1:])

    return p


def perplexity(p, text, order):
    raw = b"\n" * (order - 1) + text.encode() + b"\n"
    return float(np.exp(-np.mean([np.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1)])))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    vocab = ["the", "of", "theson", "ouatwh", "tion", "Ére", "une", "."]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(3, 40))) for _ in range(60)]


def test_tables_are_the_brute_model_on_both_paths(spark, corpus):
    tables = q.train(spark.createDataFrame([(t,) for t in [*corpus, None, ""]], "text string"), 4)
    p = brute_model([*corpus, None, ""], 4)
    assert abs(sum(p(b"the" + bytes([b])) for b in range(256)) - 1) < 1e-9
    texts = [corpus[0], "zzz \x00 ¿?", "the the the", "漢" * 50, corpus[1], corpus[1], "", None, " ".join(corpus) * 100]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string")
    here, joined = ({r.doc_id: r.perplexity for r in q.perplexity(docs, tables, in_memory=memory).collect()} for memory in (q.IN_MEMORY, 0))
    assert here == joined and len(here) == len(texts)
    for i, t in enumerate(texts):
        assert here[i] == (pytest.approx(perplexity(p, t, 4), rel=2e-6) if t else None)


def test_ranges_of_the_tables_add_up(spark, corpus, monkeypatch):
    """Ranges cover all pairs of bytes once, hold what they may and give the same sums, for frequent texts and none, too."""
    tables = q.train(spark.createDataFrame([(t,) for t in corpus], "text string"), 5)
    texts = [corpus[0], "zzz \x00 ¿?", "the the the", "漢" * 50, "", None, " ".join(corpus) * 10] + [corpus[1]] * 1200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    whole = {r.doc_id: r.perplexity for r in q.perplexity(docs, tables).collect()}
    rows = sum(t.count() for n, pair in tables.items() if n > 2 for t in pair)
    monkeypatch.setattr(q, "RANGE", rows // 4)
    ranges = q._ranges(tables, q.RANGE)
    assert len(ranges) > 2 and [low for low, _ in ranges] == [0, *(high + 1 for _, high in ranges[:-1])] and ranges[-1][1] == 65535
    large = [sum(len(x[0]) for n, pair in _rows(tables, *r).items() if n > 2 for x in pair) for r in ranges]
    assert max(large) <= q.RANGE and sum(large) == rows
    assert {r.doc_id: r.perplexity for r in q.perplexity(docs, tables, in_memory=0).collect()} == whole
    assert q.perplexity(docs.limit(0), tables, in_memory=0).count() == 0
    assert q._ranges({n: tables[n] for n in (1, 2)}, 1) == [(0, 65535)]


def _rows(tables, low, high):
    return {n: [(x.keys[x.keys >= 0],) for x in pair] for n, pair in ((n, (s.p[n], s.g[n])) for s in [q._loaded(tables, low, high)] for n in tables)}


def test_texts_longer_than_what_is_taken_at_once(spark, corpus, monkeypatch):
    tables = q.train(spark.createDataFrame([(t,) for t in corpus], "text string"), 4)
    scorer = q._shared(spark, tables, q.IN_MEMORY).value
    texts = [corpus[0], None, corpus[1] * 3, "", corpus[2]]
    whole = [x.tolist() for x in scorer.sums(texts)]
    for size in (1, 7, 64):
        monkeypatch.setattr(q, "AT_ONCE", size)
        assert [x.tolist() for x in scorer.sums(texts)] == whole


def test_each_language_has_its_threshold(spark, corpus):
    """However many languages there are, and whichever path scores."""
    langs = [f"l{i}" for i in range(12)]
    rows = [(i, t, langs[i % 12]) for i, t in enumerate(corpus * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id").selectExpr("doc_id", "1 AS quality")
    one, two = (sorted((r.doc_id, r.perplexity, r.threshold, r.kept) for r in q.classify(docs, labels, in_memory=m).collect()) for m in (q.IN_MEMORY, 0))
    assert one == two
    assert len({t for _, _, t, _ in one}) > 3


def test_noise_goes_and_clean_text_stays(spark, corpus):
    noise = ["%%% ### " * 10, "ZQ!! XW!! " * 12]
    rows = [(i, t, "en", "a") for i, t in enumerate(corpus * 5)] + [(1000 + i, t, "en", "a") for i, t in enumerate(noise)] + [(2000, None, "en", "a"), (2001, "", None, None), (2002, corpus[0], None, None), (None, corpus[1], "xx", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(i, None) for i in range(200, 210)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (1000, 1001, 2000, 2001))
    assert kept[2002] and kept[None]
    assert np.mean([kept[i] for i in range(300)]) > 0.98


def test_without_trusted_text_or_rows(spark, corpus):
    docs = spark.createDataFrame([(1, corpus[0], "en"), (2, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in q.classify(docs, none).collect()} == {1: True, 2: False}
    assert q.classify(docs.limit(0), none).count() == 0

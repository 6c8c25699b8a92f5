"""The pipeline against a version by plain Python: same rows out of each stage."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as c
from ledgerloom.llm import byte_bpe, quality_lm
from ledgerloom.llm.queries import PII_KEY, ranks_file
from tests.llm.test_decontam import brute as decontam_brute
from tests.llm.test_near_dedup import brute as dedup_brute
from tests.llm.test_quality_lm import brute_model, perplexity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, r = tmp_path_factory.mktemp("sf"), random.Random(12)
    syllables = ["the", "on", "er", "ti", "and", "ing", "ea", "st"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    texts = [" ".join(word() for _ in range(r.randint(30, 80))) for _ in range(160)]
    items = [(i, " ".join(word() for _ in range(14))) for i in range(4)]
    extra = [texts[0], texts[1] + " end", texts[2] + " " + items[0][1], items[1][1].upper() + " " + texts[3], "%%% $$$ ### " * 30, None, "", texts[4] + " 42.144.35.254 on"]
    rows = [(i, t, "en" if i % 3 else None, "s", 0 if t is None else len(t)) for i, t in enumerate(texts + extra)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_against_plain_python(spark, folder):
    d, rows, items = folder
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % quality_lm.FOLDS == 0
    p = brute_model([t for i, t, *_ in rows[:160] if not fold(i)], quality_lm.ORDER)
    held = sorted(perplexity(p, t, quality_lm.ORDER) for i, t, *_ in rows[:160] if fold(i))
    limits = {}
    for lang in ("en", None):  # percentile_approx takes the value at rank ceil(share * n)
        own = sorted(perplexity(p, t, quality_lm.ORDER) for i, t, g, *_ in rows[:160] if fold(i) and g == lang)
        limits[lang] = (own if len(own) >= 20 else held)[-1]
    good = [r for r in rows if r[1] and perplexity(p, r[1], quality_lm.ORDER) <= limits[r[2]] * (1 + 1e-4)]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = c.quality(spark, docs, d)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == [r[0] for r in good]
    docs = c.settle(one)

    first = [i for i, _, _, kept in dedup_brute([r[:2] for r in good]) if kept]
    two = c.dedup(spark, docs, d)
    assert two.columns == docs.columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(first)
    docs = c.settle(two)

    left = [r for r in good if r[0] in set(first)]
    clean = [i for i, _, hit, _ in decontam_brute([r[:2] for r in left], items) if not hit]
    three = c.decontaminate(spark, docs, d)
    assert three.columns == docs.columns
    assert sorted(r.doc_id for r in three.collect()) == sorted(clean)
    docs = c.settle(three)

    four = {r.doc_id: r for r in c.pseudonyms(spark, docs, d).collect()}
    given = {r[0]: r[1] for r in left}
    assert four.keys() == set(clean)
    assert all(r.n_chars == len(r.text) for r in four.values())
    assert all(r.text == given[i] for i, r in four.items() if "42.144" not in given[i])
    assert not any("42.144.35.254" in r.text for r in four.values())

    ranks = byte_bpe.read_ranks(ranks_file())
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    five = {r.doc_id: r for r in c.run(spark, d).collect()}
    assert five.keys() == four.keys()
    for i, r in five.items():
        ids = known.encode_ordinary(four[i].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert PII_KEY


def test_empty_documents(spark, folder, tmp_path):
    d = folder[0]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_with_repeated_ids(spark, folder):
    d, rows, items = folder
    text = [r[1] for r in rows]
    docs = lambda pairs: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    leak = text[2] + " " + items[0][1]
    given = docs([(None, leak), (None, text[3]), (7, leak), (7, text[4]), (8, None), (None, None)])
    assert got(c.decontaminate(spark, given, d)) == sorted([(None, text[3]), (7, text[4]), (8, None), (None, None)], key=str)

    given = docs([(None, text[5]), (None, text[5]), (1, text[6]), (1, text[6]), (2, text[6]), (2, text[7]), (3, text[7] + " end"), (None, text[7]), (4, ""), (4, ""), (5, ""), (None, None), (None, None)])
    out = c.dedup(spark, given, d)
    assert out.columns == given.columns
    assert got(out) == sorted([(None, text[5]), (1, text[6]), (2, text[7]), (4, ""), (5, ""), (None, None)], key=str)

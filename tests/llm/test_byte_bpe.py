import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgerloom.llm import byte_bpe
from ledgerloom.llm.queries import bpe_digests, ranks_file

RANKS = byte_bpe.read_ranks(ranks_file())
ENCODER = byte_bpe.PrefixEncoder(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = byte_bpe.splitter(P.PATTERN)
TEXTS = ["", "a", "The cat isn't here.", "x" * 5000, " \n\t  \x1c\x85   end  ", "漢字とかな 😀 naïve ²³ ½", "<|endoftext|>", "1234567 12 ٣٤", "é" * 300 + " " * 200]


@pytest.mark.parametrize("text", TEXTS)
def test_as_tiktoken(text):
    assert [i for p in SPLIT(text) for i in ENCODER.encode(p.encode())] == TIKTOKEN.encode_ordinary(text)


def test_random_texts():
    r = random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice("abest hin 'stre ouèñ1!\n") for _ in range(r.randint(1, 25)))
        assert [i for p in SPLIT(text) for i in ENCODER.encode(p.encode())] == TIKTOKEN.encode_ordinary(text)


def test_many_pieces_side_by_side():
    r = random.Random(5)
    pieces = [bytes(r.choice(b"abest hinr\xc3\xa9\xe4\xb8\xad1!\n\x00\xff") for _ in range(r.randint(1, 40))) for _ in range(5000)] + [b"x" * 300]
    for piece, packed in zip(pieces, byte_bpe.vocabulary(ranks_file()).encode(pieces), strict=True):
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == TIKTOKEN._core_bpe.encode_single_piece(piece)
    assert byte_bpe.vocabulary(ranks_file()).encode([]) == []


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 20)
    monkeypatch.setattr(byte_bpe, "GROUP", 3)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 4)
    shared = type("Shared", (), {"value": byte_bpe.vocabulary(ranks_file())})
    for packed, text in zip(byte_bpe._encoder(shared, P.PATTERN)(TEXTS), TEXTS, strict=True):
        assert packed == b"".join(i.to_bytes(4, "little") for i in TIKTOKEN.encode_ordinary(text))


def test_append_and_edit_keep_the_table_exact():
    r = random.Random(4)
    for _ in range(300):
        old = "".join(r.choice("abcdehinorst") for _ in range(r.randint(1, 200))).encode()
        last = ENCODER.extend(old, [])
        assert ENCODER.extend(old + b"ing", list(last)) == ENCODER.extend(old + b"ing", [])
        a = r.randint(0, len(old))
        b = r.randint(a, min(len(old), a + 5))
        new, table = ENCODER.edit(old, last, a, b, b"the")
        assert new == old[:a] + b"the" + old[b:]
        assert table == ENCODER.extend(new, [])


def test_round_trip_and_digests(spark):
    rows = [(i, t, "kept") for i, t in enumerate([*TEXTS, None, TEXTS[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    for r, (_, text, _) in zip(sorted(bpe_digests(docs, ranks_file()).collect()), rows, strict=True):
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_apart(spark):
    docs = spark.createDataFrame([(i, t, b"old") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, decoded binary")
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks_file(), P.PATTERN, keep_text=True), ranks_file(), keep_ids=False)
    assert out.columns == ["doc_id", "text", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())


def test_empty_table(spark):
    assert bpe_digests(spark.createDataFrame([], "doc_id long, text string"), ranks_file()).count() == 0

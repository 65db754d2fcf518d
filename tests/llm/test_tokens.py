"""Operators 5 and 10 against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import bpe, records
from lotwise.llm.common import scratch

TEXTS = [None, "", "a", "Hello world, it's 12 o'clock\n\n", "é" * 70 + " x", "ab" * 300, "  lead\t\x1c trail  ", "日本 😀 text", "<|endoftext|> x", "α Σ ΑΣ", "a\x01b \x01"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(*bpe.default_tokenizer())


@pytest.fixture(scope="module")
def reference(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_ids_equal_the_library(texts):
    import tiktoken

    e = bpe.encoder(*bpe.default_tokenizer())
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    ids = e.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert bpe.decode_batch(ids, bpe.default_tokenizer()[0]) == [t.encode() for t in texts]


def test_long_pieces(encoder, reference):
    rng = random.Random(3)
    for text in ("a" * 3000, "".join(rng.choice("abcdé") for _ in range(2000)), " " * 500, "é" * 65):
        assert np.frombuffer(encoder.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_query_columns(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "again", "x"), (None, "no id", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert hashlib.sha256(r.decoded).hexdigest() == hashlib.sha256((r.decoded).decode().encode()).hexdigest()
    got = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id != 1}
    for i, t in enumerate(TEXTS):
        if i != 1:
            assert np.frombuffer(got[i].ids, "<u4").tolist() == (reference.encode_ordinary(t) if t else [])
            assert got[i].decoded == (t or "").encode()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)] + [(3, "twin"), (3, "twin"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    folder = scratch(spark, "records")
    back = records.read_records(records.write_records(docs, folder), folder).orderBy("start").collect()
    assert len(back) == len(rows)
    assert [r.doc_id for r in back] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in back:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted((d if d is not None else -1, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(r.ids)) for r in back) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch(spark, "records")
    assert records.read_records(records.write_records(docs, folder), folder).count() == 0


def test_damage_is_found():
    data = records.frame(b"abcdef")
    assert records.unframe(data, 0) == (b"abcdef", len(data))
    for at in (0, 9, 14, len(data) - 1):
        with pytest.raises(ValueError):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], 0)


def test_clash_and_long_text(spark):
    long = "word " * 60_000 + "x" * 30_000
    docs = spark.createDataFrame([(1, long, "i", 1), (2, "a", "i", 1)], "doc_id long, text string, ids string, start int")
    folder = scratch(spark, "records")
    back = {r.doc_id: r for r in records.read_records(records.write_records(docs, folder), folder).collect()}
    assert len(back) == 2 and back[1].start == 0 and back[2].start == len(back[1].ids) // 4
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs)).collect()} == {1: long.encode(), 2: b"a"}


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(P.path("word_bpe_49k.json")), records.word_encoder(P.path("word_bpe_49k.json"))
    rng = random.Random(6)
    letters = "abcdeéèßµªºÀÉİıΣσςĀÿ×÷'’.,;:!?-12 \n\t\x01e\u0301日😀"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert np.frombuffer(enc.encode(t), f"<u{enc.width}").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)

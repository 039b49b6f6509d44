"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from grainguard.llm import bpe

RANKS = bpe.ranks_in(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    None, "", " ", "a", "Hello  world's end\n\n", "été çà 日本語 🙂🙂 x" * 5, "zzzzqqqq" * 300, "0123456789" * 90, " \t\r\n" * 50,
    "<|endoftext|> &%$", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 20, "naïve-cóoperate ’s 'LL 'll",
]
SCHEMA = "doc_id long, text string, n_tokens string, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], SCHEMA)


def test_as_the_library(spark):
    coded = bpe.encode(frame(spark, TEXTS + TEXTS), RANKS, public_tokenizers.PATTERN, decoded="decoded")
    assert coded.columns == ["doc_id", "text", "extra", "token_ids", "n_tokens", "decoded"]
    rows = {r.doc_id: r for r in coded.collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, text in enumerate(TEXTS + TEXTS):
        assert np.frombuffer(rows[i].token_ids, "<u4").tolist() == LIBRARY.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(rows[i].token_ids) // 4
        assert bytes(rows[i].decoded) == (text or "").encode()
    again = bpe.decode(coded.drop("text"), RANKS, "back").collect()
    assert all(bytes(r.back) == bytes(rows[r.doc_id].decoded) for r in again)


def test_blocks_and_long_texts(spark, monkeypatch):
    merges = bpe.Merges(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 64)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    monkeypatch.setattr(bpe, "MATRIX_CELLS", 32)
    texts = [t or "" for t in TEXTS]
    assert [i.tolist() for i in merges.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["op4_byte_bpe"])
def test_query_against_the_library(spark, name):
    from grainguard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = LIBRARY.encode_ordinary(doc.text or "")
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_schema_is_stable(spark):
    coded = bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN)
    assert coded.schema["token_ids"].dataType == T.BinaryType()


def test_two_vocabularies_of_one_size(spark):
    df = spark.createDataFrame([(1, "cdcd abab")], "doc_id long, text string").coalesce(1)
    for pair, want in ((b"ab", [99, 100, 99, 100, 32, 256, 256]), (b"cd", [256, 256, 32, 97, 98, 97, 98])):
        ranks = {bytes([b]): b for b in range(256)} | {pair: 256, b"zz": 257}
        row = bpe.encode(df, ranks, r"\S+|\s+").first()
        assert np.frombuffer(row.token_ids, "<u4").tolist() == want


def test_long_pieces_as_the_library():
    import random
    import time

    merges = bpe.Merges(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(4)
    for n in (1023, 1024, 1025, 5000, 30_000):
        word = "".join(draw.choices("etaoinshrdlué", k=n))
        assert merges.encode([word])[0].tolist() == LIBRARY.encode_ordinary(word)
    word = "".join(draw.choices("etaoinshrdlu", k=1_000_000))
    start = time.monotonic()
    ids = merges.encode([word])[0]
    assert time.monotonic() - start < 60
    assert merges.decode(ids) == word.encode() and ids.tolist() == LIBRARY.encode_ordinary(word)

"""The coder with shared tables, words encoded once against whole texts by the library, and earlier files."""

import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from grainguard.llm import tablecoder, tokencoder, wordids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = open(PATH, encoding="utf-8").read()
DRAWS = np.random.default_rng(5)
ROWS = {
    "one id": np.array([50256]),
    "two": np.array([5, 5]),
    "equal": np.zeros(5000),
    "noise": DRAWS.integers(0, 65536, 9000),
    "common": DRAWS.zipf(1.2, 9000) % 50257,
    "loop": np.tile(DRAWS.integers(0, 50257, 7), 700),
    "a block": np.arange(tablecoder.BLOCK),
    "a block and one": np.arange(tablecoder.BLOCK + 1) % 3,
    "highest": np.array([65535, 0] * 3000),
}


def lengths(n):
    return [min(tablecoder.BLOCK, n - i) for i in range(0, n, tablecoder.BLOCK)]


@pytest.mark.parametrize("name", ROWS)
def test_round_trip(name):
    ids = ROWS[name].astype(np.int32)
    payloads, sizes = tablecoder.encode_segment(ids), lengths(len(ids))
    assert len(payloads) == len(sizes) + 1
    assert np.array_equal(tablecoder.decode_segment(payloads, np.array(sizes)), ids)
    for i, n in enumerate(sizes):  # any block can be read by itself, with the tables
        one = tablecoder.decode_segment([payloads[0], payloads[i + 1]], np.array([n]))
        assert np.array_equal(one, ids[i * tablecoder.BLOCK :][:n])


def test_ids_beyond_16_bits_are_refused():
    with pytest.raises(ValueError, match="65,535"):
        tablecoder.encode_segment(np.array([65536, 1], np.int32))


def test_a_segment_costs_less_than_half_of_the_steps_before(monkeypatch):
    ids = (np.random.default_rng(1).zipf(1.3, 1 << 18) % 50257).astype(np.int32)
    documents = [len(ids)]
    before = time.process_time()
    blocks = [ids[i : i + tokencoder.BLOCK] for i in range(0, len(ids), tokencoder.BLOCK)]
    tokencoder.decode_blocks(tokencoder.encode_blocks(blocks), np.array([len(b) for b in blocks]))
    between = time.process_time()
    row = tokencoder.segment_row(0, 0, 0, pa.array([1]), np.array(documents), ids)
    back = tokencoder.segment_blocks(row["payloads"], row["block_lengths"])
    after = time.process_time()
    assert np.array_equal(np.concatenate(back), ids)
    assert after - between < (between - before) / 2


def test_damage_is_found(spark):
    ids = ROWS["common"].astype(np.int32)
    row = tokencoder.segment_row(0, 0, 0, pa.array([1]), np.array([len(ids)]), ids)
    for at, byte in ((0, 9), (0, 500), (1, 0), (3, 40)):
        bad = bytearray(row["payloads"][at])
        bad[byte] ^= 64
        payloads = [bytes(bad) if i == at else p for i, p in enumerate(row["payloads"])]
        with pytest.raises(Exception, match="damaged"):
            tokencoder.read_ids(spark.createDataFrame([row | {"payloads": payloads}], tokencoder.SEGMENT)).collect()


def test_earlier_files_are_read(spark):
    """Segments of a payload a block, without tables."""
    ids = ROWS["common"].astype(np.int32)
    blocks = [ids[i : i + tokencoder.BLOCK] for i in range(0, len(ids), tokencoder.BLOCK)]
    row = {
        "part": 0, "segment": 0, "base": 0, "keys": [4, 7], "lengths": [8000, 1000], "block_lengths": [len(b) for b in blocks],
        "block_crcs": [tokencoder.checksum(b) for b in blocks], "payloads": tokencoder.encode_blocks(blocks),
    }
    got = sorted(map(tuple, tokencoder.digests(spark.createDataFrame([row], tokencoder.SEGMENT)).collect()))
    assert got == [(4, 0, 8000, zlib.crc32(ids[:8000].astype("<u4"))), (7, 8000, 1000, zlib.crc32(ids[8000:].astype("<u4")))]


def test_segments_hold_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(tokencoder, "SEGMENT_IDS", 40)
    monkeypatch.setattr(tokencoder, "BATCH_CHARS", 100)
    rows = [(i, "word " * (i * 7 % 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    segments = tokencoder.segments_of(df, TEXT, "doc_id", "text")
    got = segments.selectExpr("keys", "aggregate(lengths, 0L, (a, b) -> a + b) AS n", "lengths").collect()
    assert sorted(k for r in got for k in r["keys"]) == list(range(80))
    assert all(r.n - r.lengths[-1] < 40 for r in got)
    assert sum(r.n >= 40 for r in got) > 10


def words_of(texts, size, config=TEXT):
    own = wordids.WordIds(config)
    parts = [own.encode(pa.array(texts[i : i + size])) for i in range(0, len(texts), size)]
    return own, [np.concatenate(x) for x in zip(*parts, strict=True)]


def same(texts, size, config=TEXT):
    own, (ids, sizes) = words_of(texts, size, config)
    wanted, many = wordids.encoded(own.library, texts)
    assert np.array_equal(ids, wanted) and np.array_equal(sizes, many)
    return own


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_the_library(seed, monkeypatch):
    monkeypatch.setattr(wordids, "KEPT_BYTES", 6000)  # forgets many times
    monkeypatch.setattr(wordids, "AT_ONCE", 50)
    r = random.Random(seed)
    signs = [
        " ", " ", "  ", "\n", "\r", "\t", " ", " ", "　", "\x1c", "\x85", "\x00", "​", "﻿", "᠎", "a", "B", "é", "é",
        "ß", "×", "÷", "ª", "²", "½", "٣", "12", "'s", "'t", "'re", "'LL", "'", "!", "...", "_", "漢字", "😀", "<|endoftext|>", " <|endoftext|> ", "x y",
    ]
    same(["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(6000)], 150)


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "Lowercase"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
    ],
)
def test_other_files_are_taken_as_they_are(change):
    own = same(["Some words  here", "", " and\nsome there "] * 3, 4, json.dumps(json.loads(TEXT) | change))
    assert not own.cut


def test_a_word_goes_to_the_library_once(monkeypatch):
    asked = []
    monkeypatch.setattr(wordids, "merged", lambda *args, of=wordids.merged: asked.extend(args[2]) or of(*args))
    same(["one two, two one two.", "and two", "one"] * 50, 20)
    assert sorted(asked) == sorted([",", ".", "Ġand", "Ġone", "Ġtwo"])

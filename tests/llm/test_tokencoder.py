"""The range coder's exact round trip, damaged blocks, and file sets against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grainguard.llm import tokencoder
from grainguard.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    """(doc_id, start, n, crc) of each row in ascending key order; equal keys in any order have equal texts."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(seed):
    r = np.random.default_rng(seed)
    sources = [
        np.zeros(4096), r.integers(0, 65536, 4096), r.zipf(1.2, 4096) % 50257, np.tile(r.integers(0, 50257, 7), 300),
        np.arange(700), np.tile([5, 6], 400), [50256], [0],
    ]
    blocks = sorted((np.array(b, np.int32) for b in sources), key=len, reverse=True)
    payloads = tokencoder.encode_blocks(blocks)
    back = tokencoder.decode_blocks(payloads, np.array([len(b) for b in blocks]))
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    assert len(payloads[0]) < 200 or len(blocks[0]) == 4096
    for one, block in zip(payloads, blocks, strict=True):  # any block can be read by itself
        assert np.array_equal(tokencoder.decode_blocks([one], np.array([len(block)]))[0], block)


def test_ids_beyond_16_bits_are_refused():
    assert tokencoder.decode_blocks(tokencoder.encode_blocks([np.array([65535, 1])]), np.array([2]))[0].tolist() == [65535, 1]
    with pytest.raises(ValueError, match="65,535"):
        tokencoder.encode_blocks([np.array([65536, 1], np.int32)])


def test_file_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencoder, "BATCH_CHARS", 50)
    rows = [(i * 13 % 101, f"text {i} wörd <|endoftext|> " * (i % 9)) for i in range(101)]
    rows += [(500, None), (501, ""), (None, "none"), (502, "x y " * 6000)] + [(7, rows[[r[0] for r in rows].index(7)][1])] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string").repartition(3)
    folder = str(tmp_path / "ids")
    tokencoder.write_ids(df, open(PATH, encoding="utf-8").read(), folder)
    read = spark.read.parquet(folder)
    got = sorted(map(tuple, tokencoder.digests(read).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    tokens = tokencoder.read_ids(read).where("doc_id = 502").first()
    assert np.frombuffer(tokens.token_ids, "<u4").tolist() == [*LIBRARY.encode("x y " * 6000).ids, 0]


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words to keep")], "doc_id long, text string")
    folder = str(tmp_path / "ids")
    tokencoder.write_ids(df, open(PATH, encoding="utf-8").read(), folder)
    bad = spark.read.parquet(folder).selectExpr("*").drop("block_crcs").selectExpr(
        "part", "segment", "base", "keys", "lengths", "block_lengths", "array(1L) AS block_crcs", "payloads"
    )
    with pytest.raises(Exception, match="damaged"):
        tokencoder.read_ids(bad).collect()


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "ids")
    tokencoder.write_ids(spark.createDataFrame([], "doc_id long, text string"), open(PATH, encoding="utf-8").read(), folder)
    assert tokencoder.digests(spark.read.parquet(folder)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op10_context_mixing_coder"](spark, sf).collect()))
    assert got == sorted(expected(rows))


def test_payloads_stay_as_they_are():
    """Files that were written before can be read: the very bytes are fixed."""
    r = np.random.default_rng(3)
    blocks = [r.integers(0, 65536, 4096), r.zipf(1.2, 3000) % 50257, np.tile(r.integers(0, 50257, 7), 300), np.tile([5, 6], 400), np.array([0])]
    payloads = tokencoder.encode_blocks(blocks)
    assert zlib.crc32(b"".join(payloads)) == 2245322555
    assert all(np.array_equal(a, b) for a, b in zip(tokencoder.decode_blocks(payloads, np.array([len(b) for b in blocks])), blocks, strict=True))


def test_only_blocks_that_moved_a_byte_are_looked_at_again(monkeypatch):
    """One block that moves costs the others no further look."""
    looked = []

    class Numpy:
        def __getattr__(self, name):
            return getattr(np, name)

        def where(self, condition, *values):
            looked.append(len(condition))
            return np.where(condition, *values)

    coder = tokencoder.Encoder(100)
    coder.low[:], coder.range[:] = 0x00FF0000, 0x01000000  # the top byte is open
    coder.low[7], coder.range[7] = 0, 1 << 17  # this one's is settled
    monkeypatch.setattr(tokencoder, "np", Numpy())
    coder.put(np.arange(100), np.zeros(100, np.int64), np.ones(100, np.int64), 2)
    assert coder.size[7] >= 1 and coder.size.sum() == coder.size[7]
    assert looked and max(looked) == 1

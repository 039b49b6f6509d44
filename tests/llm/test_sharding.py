"""Histogram sort against a plain running sum."""

import zlib

import pytest

from grainguard.llm import sharding
from grainguard.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, Slot string"


def expected(rows, shards):
    """(doc_id, shard, slot) by a running sum in key order; ties in the order of reading."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    sizes = [len((r[1] or "").encode()) + 16 for r in rows]
    total, before, slots, out = sum(sizes), 0, [0] * shards, []
    for row, size in zip(rows, sizes, strict=True):
        shard = sum(1 for i in range(1, shards) if before >= -(-total * i // shards))
        out.append((row[0], row[1], shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


CASES = {
    "plain": [(i * 37 % 1009 - 300, "é" * (i % 50)) for i in range(1009)],
    "one hot key": [(7, "x" * (i % 5)) for i in range(600)] + [(i, "yy") for i in range(300)],
    "equal rows": [(5, "same")] * 400 + [(2**62, None), (-(2**62), ""), (None, "n"), (None, "n")],
    "a giant": [(1, "a"), (2, "b" * 100_000), (3, "c")] + [(i, "d") for i in range(4, 90)],
    "one": [(1, None)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("shards", [1, 7])
def test_against_running_sum(spark, name, shards):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in CASES[name]], SCHEMA).repartition(3)
    out = sharding.shard_by_bytes(docs, shards).collect()
    if name in ("plain", "a giant", "one"):  # keys differ: the order is known
        assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in out) == sorted(expected(CASES[name], shards))
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((k or 0, t or "") for k, t in CASES[name])
    for shard in {r.shard for r in out}:
        mine = sorted(r.slot for r in out if r.shard == shard)
        assert mine == list(range(len(mine)))
    largest = max(r.size for r in out)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(shards)]
    assert max(abs(x - sum(sizes) / shards) for x in sizes) <= largest


def test_tolerance_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_BYTES", 500)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 40 AS INT)) AS text")
    out = sharding.shard_by_bytes(docs, 4, tolerance=0.02).collect()
    assert len(out) == 3000
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * 0.02 * sum(sizes) / 4 + 100
    for shard in range(4):
        mine = sorted((r.doc_id, r.slot) for r in out if r.shard == shard)
        assert [slot for _, slot in mine] == list(range(len(mine)))


def test_empty_table(spark):
    out = sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA), 5)
    assert out.count() == 0 and "slot" in out.columns


def test_query_against_running_sum(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op1_histogram_sort"](spark, sf).collect()
    text = dict(docs)
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((k, s, p) for k, _, s, p in expected(docs, 40))
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)

"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from grainguard.llm import repeats
from grainguard.llm.hashing import word_hashes
from grainguard.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """One (doc_id, n, removed, kept) per row; rows with one key must have one text."""
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = words_of(t)
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {i + k for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i) for k in range(20)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def made(seed):
    r = random.Random(seed)
    rare, few = [f"w{i}é" for i in range(400)], ["a", "b", "A"]
    text = lambda n, v=rare: [r.choice(v) for _ in range(n)]
    passage, line = text(70), text(25)
    rows = [text(r.choice([0, 1, 19, 20, 21, 60, 300])) for _ in range(60)]
    rows += [text(r.randint(0, 30)) + passage[r.randint(0, 30) : r.randint(40, 70)] + text(r.randint(0, 30)) for _ in range(60)]
    rows += [line + text(3) + line + line for _ in range(20)]
    rows += [["same"] * n for n in (5, 19, 20, 21, 200)] + [["x", "y"] * n for n in (9, 10, 11, 150)] + [["p", "q", "q"] * 60]
    rows += [text(120, few) for _ in range(20)] + [list(rows[k]) for k in (3, 70, 71, 130)]
    r.shuffle(rows)
    return [(i * 5 % 997, r.choice([" ", "\n", "\t \r"]).join(w)) for i, w in enumerate(rows)]


EXTRA = [(2000, None), (2001, ""), (2002, " \x0b\n"), (None, " ".join(f"w{i}" for i in range(30)))]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_dictionary(spark, seed, small, monkeypatch):
    if small:
        monkeypatch.setattr("grainguard.llm.hashing.BLOCK_BYTES", 300)
        monkeypatch.setattr(repeats, "PART", 32)
    rows = made(seed) + EXTRA
    rows = rows + rows[:3] + [(3000, EXTRA[3][1])]  # rows that repeat are one document
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_words string").repartition(5)
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_equal_windows_have_equal_keys(spark):
    r = np.random.default_rng(3)
    alphabet = [f"t{i}".encode() for i in range(6)] * 3 + [f"u{i}".encode() for i in range(50)]
    texts = [word_hashes(b" ".join(alphabet[i] for i in r.integers(0, len(alphabet), 300))) for _ in range(20)]
    texts += [np.concatenate([texts[i][:50], texts[i + 1][100:180], texts[i][10:90]]) for i in range(19)]
    names, text, low, high = repeats.stretches(texts)
    key_of, count = {}, 0
    for name, i, a, b in zip(names, text, low, high, strict=True):
        for at in range(a, b + 1):
            assert key_of.setdefault(texts[i][at : at + 20].tobytes(), name) == name
            count += 1
    assert count == sum(len(t) - 19 for t in texts)
    assert len(set(key_of.values())) < len(key_of) / 3  # most windows share keys with their neighbours


def test_shared_keys_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, line), (1, line + " z"), (1, line)], "doc_id long, text string")
    rows = sorted((r.text, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert [t for t, _ in rows] == [line, line, line + " z"]
    assert rows[0][1] == rows[1][1] and {rows[0][1], rows[2][1]} == {0, 25}
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_recompression"](spark, sf).collect()))
    assert got == sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows))

"""Near-duplicate groups against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from grainguard.llm import neardup
from grainguard.llm.queries import QUERIES


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """One (doc_id, n, component, kept) per row, from an inverted index over all shingles."""
    sets = sorted({shingles(t) for _, t in rows if shingles(t)}, key=lambda s: (len(s), sorted(s)))
    where, parent = {}, list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in where.get(x, ()):
                seen[j] = seen.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, n in seen.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    number = {s: i for i, s in enumerate(sets)}
    least = {}
    for d, t in rows:
        if shingles(t) and d is not None:
            r = root(number[shingles(t)])
            least[r] = min(d, least.get(r, d))
    out = []
    for d, t in rows:
        c = least.get(root(number[shingles(t)]), d) if shingles(t) else d
        out.append((d, len(shingles(t)), c, d == c))
    return out


def made(seed):
    r = random.Random(seed)
    vocabulary = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(40), []
    for _ in range(60):
        rows.append(text(r.choice([1, 3, 4, 5, 6, 30, 200])))
    for _ in range(60):
        rows.append(text(20) + passage + text(20))  # share a passage, are no copies
    for size in (2, 3, 40, 120):
        own = text(150)
        for _ in range(size):
            copy = list(own)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8, 12])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(copy)
    own = text(100)  # parts of a text, of sizes that differ
    rows += [own[r.randint(0, 25) : r.randint(60, 100)] for _ in range(60)]
    chain = text(120)
    for _ in range(40):
        chain = chain[3:] + text(3)
        rows.append(list(chain))
    r.shuffle(rows)
    out = [(i * 7 % 1009, " ".join(w).title() if i % 3 else "\n\t".join(w)) for i, w in enumerate(rows)]
    return out + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "ONE two"), out[4], (out[5][0], out[6][1])]


SCHEMA = "doc_id long, text string, component_id string"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block,short", [(4096, 64), (8, 64), (8, 2)])
def test_against_all_pairs(spark, seed, block, short, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHORT", short)
    rows = made(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = [tuple(r) for r in neardup.near_duplicates(df).drop("content").collect()]
    assert sorted(out) == sorted(brute(rows))
    if short == 2:
        kept = neardup.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(kept.groupBy("doc_id").count().collect()) == sorted(
            Counter(d for d, _, _, stays in brute(rows) if stays).items()
        )


def test_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (None, "z", "x"), (None, None, "x")], SCHEMA)
    out = sorted(map(tuple, neardup.near_duplicates(df).drop("content").collect()), key=str)
    assert out == sorted([(None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 0, None, True)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_coordinate_join"](spark, sf).collect())) == sorted(brute(rows))


def test_folded_shingles_bound_what_two_sets_share():
    rng = np.random.default_rng(3)
    pool = neardup.mix(np.arange(1, 6001, dtype=np.uint64))
    for size in (0, 1, 40, 700, 5000):
        sets = [np.sort(rng.choice(pool, size, replace=False)) for _ in range(8)]
        bits = [neardup.folded(s) for s in sets]
        for s, (f, spare) in zip(sets, bits, strict=True):
            assert len(f) * 64 == neardup.FRINGE
            for t, (g, other) in zip(sets, bits, strict=True):
                both = sum(int(x).bit_count() for x in (f & g).view(np.uint64).tolist())
                assert len(np.intersect1d(s, t)) <= both + min(spare, other)
    assert neardup.folded(None) == (None, None)

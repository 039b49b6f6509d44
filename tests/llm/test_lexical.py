"""Ranked search against a brute-force version."""

import math
import random
import re
from collections import Counter

from grainguard.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score string, item_id string, rank int"
ITEMS = "item_id long, text string, doc_id string"


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top):
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * total) // words
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=repr)


def got(spark, docs, items, top, **more):
    d = spark.createDataFrame([(*row, "x", "y", 1) for row in docs], DOCS)
    i = spark.createDataFrame([(*row, "z") for row in items], ITEMS)
    found = lexical.search(d.repartition(5), i, top, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    pool = ["The", "of", "é", "É", "a-b", "x1", "Zoo", "fin", "Ünder", "ok", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(draw.choices(pool, k=draw.choice((0, 1, 3, 20, 200))))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # copies: ties
    docs += [(None, docs[7][1]), (3, docs[3][1]), (2000, None), (2001, " .,\n\t"), (2002, "the " * 50_000), (-5, docs[7][1])]
    items = [(i, " ".join(draw.sample(pool, k=draw.choice((1, 4, 12, 30))))) for i in range(40)]
    items += [(40, items[3][1]), (41, items[3][1] + " more"), (42, None), (43, ""), (44, "unheard"), (None, "the zoo"), (1, "extra x1 x1")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(5)
    for top in (1, 7, 50):
        assert got(spark, docs, items, top) == brute(docs, items, top)
    assert got(spark, docs, items, 7, block_items=9) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus(6)
    assert got(spark, [], items, 5) == [] == got(spark, docs, [], 5)
    assert got(spark, [(1, None)], items, 5) == []


def test_sets_are_shared_and_whole():
    _, items = corpus(8)
    terms = sorted({t for _, text in items for t in split(text)})
    sets = [{terms.index(t) for t in split(text)} for _, text in items]
    sets = [s for s in sets if s]
    inner, tops = lexical.shared_sets(sets, len(terms))

    def leaves(node):
        return [node] if node < len(terms) else [leaf for c in inner[node - len(terms)] for leaf in leaves(c)]

    for own, top in zip(sets, tops, strict=True):
        found = [leaf for node in top for leaf in leaves(node)]
        assert sorted(found) == sorted(own)
    # Sums to make: fewer along the DAG than term by term.
    assert sum(len(c) - 1 for c in [*inner, *tops]) < 0.7 * sum(len(s) - 1 for s in sets)


def test_narrow_matrices():
    docs, items = corpus(9)
    asked = {i: {t.encode() for t in split(text)} for i, text in enumerate(t for _, t in items)}
    found = Counter(t for _, text in docs for t in {t.encode() for t in split(text)})
    words = sum(len(split(t)) for _, t in docs)
    wide = lexical.Search(asked, found, sum(bool(split(t)) for _, t in docs), words)
    texts = [(t or "").encode() for _, t in docs]
    whole = wide.scores(texts)
    best, narrow = lexical.Best(len(wide.items), 3), lexical.Best(len(wide.items), 3)
    import numpy as np

    ids, absent = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    best.add(whole, ids, absent)
    best.shrink()
    narrow.limit = 1
    for k in range(len(texts)):
        narrow.add(wide.scores(texts[k : k + 1]), ids[k : k + 1], absent[k : k + 1])
    narrow.shrink()
    assert [r.tolist() for r in best.rows] == [r.tolist() for r in narrow.rows]

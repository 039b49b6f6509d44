"""Containment search against brute force."""

import random
import re

import pytest

from grainguard.llm import decontam


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items, percent=75):
    held, wanted = {}, {}
    for key, text in docs:
        held.setdefault(key, set()).update(shingles(text))
    for key, text in items:
        wanted.setdefault(key, set()).update(shingles(text))
    return {
        (d, i, len(q), len(s & q))
        for d, s in held.items()
        for i, q in wanted.items()
        if q and s and len(s & q) * 100 >= len(q) * percent and s & q
    }


def made(seed):
    r = random.Random(seed)
    vocabulary = ["Une", "two", "THREE", "vier", "è", "x", "of", "the"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([2, 4, 5, 7, 12, 30, 60]))) for i in range(40)] + [(None, text(9)), (3, text(8))]
    phrase = "answer the next question in one word please "
    items += [(100 + i, phrase + text(6)) for i in range(30)]
    docs = [(i, text(r.randint(0, 300))) for i in range(60)]
    for i in range(60, 160):
        words = (r.choice(items)[1]).split()
        if r.random() < 0.5 and len(words) > 8:
            words[r.randrange(len(words))] = "changed"
        docs.append((i, f"{text(r.randint(0, 40))}\t{' '.join(words)}\n{text(r.randint(0, 40))}"))
    return docs + [(500, None), (501, ""), (502, " \n"), (None, items[5][1]), (60, docs[61][1])] + docs[:3], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_against_brute_force(spark, seed, broadcast):
    docs, items = made(seed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = decontam.contained_items(
            spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, item_id int, h string"),
            spark.createDataFrame(items, "item_id long, text string"),
        ).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(out) == len(set(out))
    assert {tuple(r) for r in out} == brute(docs, items)


def test_removal_and_empty_tables(spark):
    docs, items = made(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, *_ in brute(docs, items)}
    kept = decontam.without_items(frame, wanted).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(d), t or "") for d, t in docs if d not in bad)
    assert decontam.without_items(frame.limit(0), wanted).count() == 0
    assert decontam.without_items(frame, wanted.limit(0)).count() == len(docs)

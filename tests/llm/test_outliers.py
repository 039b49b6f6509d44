"""Counts against plain Python; the estimates against numpy; junk among clean texts."""

import random
import re

import numpy as np
import pytest

from grainguard.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {p + k for at in where.values() if len(at) > 1 for p in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def clean(r, n, lang):
    stem = {"en": ["the", "of", "and", "house", "rivers", "a"], "de": ["und", "der", "Häuser", "Straßen", "gegangen"]}[lang]
    return " ".join(r.choice(stem) + r.choice("abcdefgh") + r.choice("stuvwxyz") for _ in range(n))


def made(seed):
    r = random.Random(seed)
    rows = []
    for i in range(700):
        lang = r.choice(["en", "en", "de"])
        text = clean(r, r.choice([12, 40, 200]), lang)
        if i % 13 == 0:
            text = " ".join(x + r.choice(["###", "%%%"]) for x in text.split())
        if i % 9 == 0:
            text += "\n" + text[:30] + "\n" + text[:30]
        rows.append((i, text, lang, "hot" if i % 3 else f"s{i % 4}", "x"))
    odd = [(800, None, None, None, "x"), (801, "", "en", "hot", None), (802, " \n\t", "en", None, "x"), (803, "a b " * 400, "de", "rare", "x")]
    return rows + odd + rows[:2] + [(None, rows[5][1], "en", "hot", "x")]


SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def test_counts(spark):
    rows = made(1)
    extra = [(900, "a b c d e a b c d e", "", "", ""), (901, "x\n\nx\n x\nx", "", "", ""), (902, "z " * 30, "", "", ""), (903, "é😀 #" * 9, "", "", "")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    out = outliers.counts(df.withColumnRenamed("n_words", "other"), "text", "doc_id").collect()
    key = lambda d: -1 if d is None else d
    got = sorted((key(r.doc_id), *(r[c] for c in outliers.COUNTS)) for r in out)
    assert got == sorted((key(d), *plain_counts(t)) for d, t, *_ in rows + extra)


def plain_estimate(x, third):
    """The same starts and concentration steps with numpy, for one group."""
    floor = np.diag([v**2 for v in outliers.FEATURES.values()])

    def d2(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def low(v, q):
        return np.sort(v)[int(np.ceil(q * len(v))) - 1]

    med = np.array([low(col, 0.5) for col in x.T])
    mad = np.array([low(np.abs(col - m), 0.5) for col, m in zip(x.T, med, strict=True)])
    cov = lambda rows: np.cov(rows.T, bias=True)
    starts = [(med, np.diag((1.4826 * mad) ** 2) + floor), (x.mean(0), cov(x) + floor), (x[third].mean(0), cov(x[third]) + floor)]
    found = []
    for m, c in starts:
        for _ in range(outliers.STEPS):
            d = d2(m, c)
            near = x[d <= low(d, outliers.KEPT_SHARE)]
            m, c = near.mean(0), cov(near) * outliers.CONSISTENCY + floor
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    d = d2(m, c)
    return d / max(1.0, low(d, 0.5) / outliers.MEDIAN)


def test_estimates_against_numpy(spark):
    from pyspark.sql import functions as F

    rows = [r for r in made(2) if r[0] is not None and r[0] < 700]
    df = spark.createDataFrame(rows, SCHEMA).drop("n_words").withColumns({"lang": F.lit("en"), "source": F.lit("one")}).distinct()
    judged = outliers.judge(df).where("NOT base_failed").select("doc_id", "content", "distance")
    third = judged.withColumn("third", F.pmod(F.xxhash64(F.xxhash64("doc_id", "content")), F.lit(3)) == 0)
    shape = outliers.features(outliers.counts(df, "text", "doc_id"))
    data = third.join(shape, "doc_id").toPandas()
    wanted = plain_estimate(data[outliers.NAMES].to_numpy(), data.third.to_numpy())
    assert np.allclose(wanted, data.distance.to_numpy(), rtol=1e-6)


@pytest.mark.parametrize("seed", [3, 4])
def test_junk_goes_and_clean_stays(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    out = outliers.judge(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 700:
            n, _, symbols, _, repeat = plain_counts(dict((d, t) for d, t, *_ in rows)[r.doc_id])
            assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
            assert r.kept == (not r.base_failed and symbols == 0)
    kept = outliers.keep_inliers(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in out)


def test_empty_and_tiny_tables(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    assert outliers.judge(df.limit(0)).count() == 0
    assert outliers.keep_inliers(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", None, None, "x")], SCHEMA)
    assert outliers.judge(one).first().kept
    assert outliers.judge(one.withColumn("text", one.text.substr(1, 7))).first().kept is False


def test_small_sources_are_judged_by_themselves(spark):
    r = random.Random(6)
    marked = lambda n: " ".join(x + "###" for x in clean(r, n, "en").split())
    rows = [(i, clean(r, 60, "en"), "en", "big") for i in range(300)]
    rows += [(1000 + i, clean(r, 60, "en"), "en", f"prose{i % 5}") for i in range(200)]
    rows += [(2000 + i, marked(r.choice([50, 60])), "en", "code") for i in range(40)]
    rows += [(3000 + i, marked(60), "en", f"prose{i}") for i in range(5)] + [(4000, marked(60), "en", "lone"), (4001, clean(r, 60, "en"), "en", "tidy")]
    kept = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[d] for d in kept if d < 3000 or d == 4001)  # code is clean where all are code
    assert not any(kept[d] for d in range(3000, 3005))  # but not among prose
    assert not kept[4000]


def test_one_statistic_alone_rejects(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(r.choice([100, 300, 500])), "en", "one") for i in range(150)]
    single = [word() for _ in range(25)]
    lines = "\n".join(r.sample(single * 3, 75))
    rows.append((200, f"{text(25)}\n{lines}", "en", "one"))  # half of the words are lines again
    passage = text(50)
    rows.append((201, f"{passage} {text(400)} {passage}", "en", "one"))  # all but what the base rule rejects
    few = text(5)
    rows.append((202, f"{few} {text(90)} {few}", "en", "one"))  # one repeat by chance
    out = {x.doc_id: x for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(x.base_failed for x in out.values())
    assert out[200].n_dup_lines == 50 and out[200].n_repeat_words == 0 and not out[200].kept
    assert out[201].n_repeat_words == 100 and out[201].n_dup_lines == 0 and not out[201].kept
    assert all(out[d].kept for d in out if d < 200 or d == 202)

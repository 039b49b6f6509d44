"""The pipeline's stages against brute force, each on its own input; the driver contract."""

import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from grainguard.llm import bpe, outliers
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_neardup import brute as copies
from tests.llm.test_outliers import plain_counts
from tests.llm.test_pii import PLAIN, plain_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        folder = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append((before, docs))
    return out


def test_columns(stages):
    wanted = stages[0][0].columns
    assert all(after.columns == wanted for _, after in stages[:-1])
    assert stages[-1][1].columns == [*wanted, "token_ids", "n_tokens"]


def test_quality(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    verdicts = {r.doc_id: r.kept for r in outliers.judge(before).collect()}
    assert kept == {d for d, k in verdicts.items() if k}
    for r in before.collect():
        n, *_, repeat = plain_counts(r.text)
        assert r.doc_id not in kept or not (n < 10 or 100 * repeat > 20 * n)


def test_near_duplicates(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, _, kept in copies(rows) if kept)


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)


def test_personal_data(stages):
    before, after = stages[3]
    clean = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        own = clean[r.doc_id]
        assert own.n_chars == len(own.text)
        assert not any(re.search(PLAIN[k], own.text) and s.startswith(k) for k in PLAIN for s in plain_base(own.text))
        if not re.search("[0-9@]", r.text):
            assert own.text == r.text


def test_tokens(stages):
    before, after = stages[4]
    ranks = bpe.ranks_in(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in after.collect()}
    assert len(rows) == before.count()
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(r.text) for r in rows.values())


def test_ids_are_decoded(spark, stages, monkeypatch):
    before, after = stages[4]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in before.collect()}
    encode, called = bpe.encode, []

    def spoiled(*args, decoded=None, **others):
        called.append(decoded)
        out = encode(*args, decoded=decoded, **others)
        return out.withColumn(decoded, F.concat(decoded, F.lit(b"?"))) if decoded else out

    texts = [(1, "wörd 😀\n"), (2, ""), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.encode_tokens(spark, df, SF).orderBy("doc_id").collect()] == texts
    monkeypatch.setattr(bpe, "encode", spoiled)
    with pytest.raises(Exception, match="decode to other bytes"):
        corpus_pipeline.encode_tokens(spark, df, SF).collect()
    assert all(called)


def test_run_and_registration(spark, stages):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    got = {r.doc_id: bytes(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: bytes(r.token_ids) for r in stages[-1][1].collect()}


PLAIN_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["content", "spans", "kept", "node", "key", "g", "distance", "item_id", "hub", "n_words", "digest", "component"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    """NULLs in every column, empty and repeated rows, names that operators use themselves, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = " ".join(f"word{i % 40} of{i % 7}" for i in range(60))
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (2, None, "en", "a", None), (3, "", None, None, 0), (None, prose + " tail", None, "a", 1)]
    rows += [(4, " \n\t", "en", None, 3), (5, "mail me at a@b.de or 10.0.0.4 " + prose[::-1], "en", "a", 5)]
    schema = PLAIN_COLUMNS + "".join(f", {c} string" for c in CLASHES)
    df = spark.createDataFrame([(*r, *(f"kept as it is: {c}" for c in CLASHES)) for r in rows], schema)
    added = ["token_ids", "n_tokens"] if name == "encode_tokens" else []
    out = stage(spark, df, SF)
    assert out.columns == [*df.columns, *added]
    got = out.collect()
    assert all(r[c] == f"kept as it is: {c}" for r in got for c in CLASHES)
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    if name == "quality_rules":  # texts of fewer than ten words and those that repeat themselves go
        assert set(ids) <= {-1, 1, 5}
    else:  # equal rows have the least key of their group in common, and a row without a key links nothing itself
        assert ids == [-1, 1, 1, 2, 3, 4, 5]
    if name == "personal_data":
        texts = {r.doc_id: r.text for r in got}
        assert "[EMAIL]" in texts[5] and "[IP]" in texts[5] and texts[2] is None and texts[3] == ""
    empty = stage(spark, df.limit(0), SF)
    assert empty.columns == [*df.columns, *added] and empty.count() == 0

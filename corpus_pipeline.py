"""Corpus preparation from end to end: each stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainguard.llm import bpe, decontam, neardup, outliers, pii
from grainguard.session import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return outliers.keep_inliers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_items(docs, items.select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE token ids of the kept, cleaned texts; ``text`` is what they decode to, or the job fails."""
    import public_tokenizers

    ranks = bpe.ranks_in(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="__decoded")
    text, back = F.col("text"), F.col("__decoded")
    same = back == F.coalesce(text, F.lit("")).cast("binary")
    failed = F.raise_error(F.concat(F.lit("ids decode to other bytes than the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("NULL"))))
    whole = F.when(same, F.when(text.isNotNull(), back.cast("string"))).otherwise(failed.cast("string"))
    return coded.withColumn("text", whole).drop("__decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encode_tokens", encode_tokens),
]

#: The outlier estimates, the span classifier and the merges can't be stated in SQL; tests hold run() against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Partial results of micro-batches, kept in few parts by levelled merging.

Each micro-batch adds one part of level 0. Where a level has ``fanout`` parts, they are folded into one of the next, so
after n batches there are at most (fanout - 1) * log(n) parts, and a row is rewritten once a level. Which parts count
is said by a manifest of a few lines (``sources.manifests``). A batch or a merge that dies before its rename has changed nothing: its folder is not
listed, and the repetition overwrites it. One that is repeated after its rename finds its batch listed and adds
nothing. Parts that have been folded stay for readers of an earlier manifest until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainguard.sources import manifests
from grainguard.streaming import files

FANOUT = 8
Fold = Callable[[DataFrame], DataFrame]


def manifest(spark: SparkSession, out: str) -> dict:
    """The latest manifest: its version, the last batch and the parts, each a folder, a level and its first batch."""
    return {"batch": -1, "parts": []} | manifests.latest(spark, out)


def publish(spark: SparkSession, out: str, now: dict, batch: int, parts: list[dict]) -> dict:
    return manifests.publish(spark, out, now, batch=batch, parts=parts)


def _read(spark: SparkSession, out: str, parts: list[dict]) -> DataFrame:
    return spark.read.parquet(*(f"{out}/parts/{part['folder']}" for part in parts))


def read_parts(spark: SparkSession, out: str) -> DataFrame:
    """All live parts; their fold is the result of all batches."""
    parts = manifest(spark, out)["parts"]
    if not parts:
        raise ValueError(f"no batch has been written to {out} yet")
    return _read(spark, out, parts)


def commit(spark: SparkSession, out: str, batch_id: int, df: DataFrame, fold: Fold, fanout: int = FANOUT) -> None:
    """Add a micro-batch's partial result, once, and fold levels that are full."""
    now = manifest(spark, out)
    if batch_id > now["batch"]:
        folder = f"0-{batch_id}"
        df.write.mode("overwrite").parquet(f"{out}/parts/{folder}")
        now = publish(spark, out, now, batch_id, [*now["parts"], {"folder": folder, "level": 0, "first": batch_id}])
    while True:
        levels = [part["level"] for part in now["parts"]]
        full = next((level for level in sorted(set(levels)) if levels.count(level) >= fanout), None)
        if full is None:
            return
        old = [part for part in now["parts"] if part["level"] == full]
        first = min(part["first"] for part in old)
        folder = f"{full + 1}-{first}"
        fold(_read(spark, out, old)).write.mode("overwrite").parquet(f"{out}/parts/{folder}")
        rest = [part for part in now["parts"] if part["level"] != full]
        now = publish(spark, out, now, now["batch"], [*rest, {"folder": folder, "level": full + 1, "first": first}])


def vacuum(spark: SparkSession, out: str) -> list[str]:
    """Delete the parts and manifests that the latest manifest has replaced; for times without readers and writers."""
    now = manifest(spark, out)
    live = {part["folder"] for part in now["parts"]}
    gone = [f"parts/{name}" for name in manifests.listed(spark, f"{out}/parts") if name not in live]
    gone += [f"manifest/{name}" for name in manifests.listed(spark, f"{out}/manifest") if name != f"{now['version']}.json"]
    manifests.delete(spark, out, gone)
    return sorted(gone)


def run_folded(
    stream: DataFrame, out: str, reduce: Callable[[DataFrame, int], DataFrame], fold: Fold, mode: str = "append", fanout: int = FANOUT
) -> str:
    """Run a stream over all data there is and keep what ``reduce`` makes of each micro-batch, folded by ``fold``.

    ``fold`` takes rows of parts to fewer rows of the same columns, and folding folded rows with more gives what
    folding all at once would.
    """
    spark = stream.sparkSession
    files.run_batches(stream, out, mode, lambda batch, batch_id: commit(spark, out, batch_id, reduce(batch, batch_id), fold, fanout))
    return out

"""Numbered manifests: small JSON files that say which folders or files make up a table or a result.

Each change puts the next number in place by one rename, which fails where the number is taken. So a reader sees one
state or the next, a writer that dies before its rename has changed nothing, and of two writers one is refused.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession


def resolved(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    path, fs = resolved(spark, folder)
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []


def latest(spark: SparkSession, root: str) -> dict:
    """The latest manifest; version 0 before the first."""
    versions = [int(name[:-5]) for name in listed(spark, f"{root}/manifest") if name.endswith(".json") and name[:-5].isdigit()]
    if not versions:
        return {"version": 0}
    path, fs = resolved(spark, f"{root}/manifest/{max(versions)}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, now: dict, **content) -> dict:
    """Put the manifest after ``now`` in place; fails if another writer has done so since ``now`` was read."""
    found = {"version": now["version"] + 1, **content}
    draft, fs = resolved(spark, f"{root}/manifest/{os.urandom(8).hex()}.draft")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(found).encode()))
    stream.close()
    final, _ = resolved(spark, f"{root}/manifest/{found['version']}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_overwrite)
    return found


def delete(spark: SparkSession, root: str, names: list[str]) -> None:
    for name in names:
        path, fs = resolved(spark, f"{root}/{name}")
        fs.delete(path, True)

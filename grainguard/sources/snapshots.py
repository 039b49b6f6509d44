"""Tables that jobs change in place of a rewrite: files of Parquet and a manifest that lists the live ones.

``write_back`` applies a change that drops or alters some rows. It asks which files hold such a row, for which Parquet
statistics and pushed filters skip what can't, rewrites those files alone, each by itself, and publishes a manifest
in which the new files replace them. All others keep their names and bytes. A change that hits no row publishes
nothing, so a second run of the same change does nothing. Before its manifest is in place a change is not to be seen,
and one that dies leaves only files that no manifest lists. Old files stay for readers of an earlier manifest until
``vacuum``. What the driver holds is the list of file names, as it does for every file that Spark reads.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainguard.sources import manifests

FILE = "__file"
#: What a change says of each row, in a column of this name.
ACTION = "__action"
KEEP, DROP, ALTER = "keep", "drop", "alter"


def _file() -> Column:
    """Hash of the path of a row's file below the table's folder: it travels with every row, so a long will do."""
    return F.xxhash64(F.substring_index(F.col("_metadata.file_path"), "/", -2))


def _named(spark: SparkSession, files: list[str], hashes: list[int]) -> list[str]:
    """The files with these hashes. Should two share one, both are rewritten, and rows stay as they have to be."""
    names = spark.createDataFrame([(name,) for name in files], "name string").select("name", F.xxhash64("name").alias(FILE))
    return sorted(row["name"] for row in names.where(F.col(FILE).isin(hashes)).collect())


def _new_files(spark: SparkSession, root: str, folder: str) -> list[str]:
    return sorted(f"{folder}/{name}" for name in manifests.listed(spark, f"{root}/{folder}") if name.endswith(".parquet"))


def create(df: DataFrame, root: str) -> dict:
    """Write a table's first files and its first manifest; the folder must not hold a table yet."""
    spark = df.sparkSession
    now = manifests.latest(spark, root)
    if now["version"]:
        raise ValueError(f"{root} holds a table already")
    folder = f"files-{os.urandom(8).hex()}"
    df.write.parquet(f"{root}/{folder}")
    return manifests.publish(spark, root, now, schema=df.schema.json(), files=_new_files(spark, root, folder))


def files_of(spark: SparkSession, root: str) -> list[str]:
    return manifests.latest(spark, root)["files"]


def _read(spark: SparkSession, root: str, now: dict, files: Iterable[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(now["schema"]))
    paths = [f"{root}/{name}" for name in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    now = manifests.latest(spark, root)
    return _read(spark, root, now, now["files"])


def write_back(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> dict:
    """Apply a change; the counts of files rewritten and kept, and the manifest's version.

    ``change`` takes rows to rows of the same columns, and any further ones it was given, with ``ACTION`` beside them:
    'keep', 'drop' or 'alter', never NULL. It returns every row and judges each by itself or against other tables, as it
    is given whole files, but not all of them.
    """
    now = manifests.latest(spark, root)
    if not now["files"]:
        return {"version": now["version"], "rewritten": 0, "kept": 0}
    columns = _read(spark, root, now, now["files"]).columns
    named = _read(spark, root, now, now["files"]).withColumn(FILE, _file())
    hit = change(named).where(F.col(ACTION) != KEEP).select(FILE).distinct()
    touched = _named(spark, now["files"], [row[FILE] for row in hit.collect()])  # a number a file
    if not touched:
        return {"version": now["version"], "rewritten": 0, "kept": len(now["files"])}
    folder = f"files-{os.urandom(8).hex()}"
    rows = change(_read(spark, root, now, touched).withColumn(FILE, _file())).where(F.col(ACTION) != DROP)
    # A file's rows stay together, so what statistics could skip before they can skip after.
    rows.repartition(len(touched), FILE).select(*columns).write.parquet(f"{root}/{folder}")
    kept = [name for name in now["files"] if name not in set(touched)]
    done = manifests.publish(spark, root, now, schema=now["schema"], files=[*kept, *_new_files(spark, root, folder)])
    return {"version": done["version"], "rewritten": len(touched), "kept": len(kept)}


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete files and manifests that the latest manifest has replaced; for times without readers and writers."""
    now = manifests.latest(spark, root)
    live = set(now["files"])
    gone = [f"manifest/{name}" for name in manifests.listed(spark, f"{root}/manifest") if name != f"{now['version']}.json"]
    for folder in manifests.listed(spark, root):
        if folder.startswith("files-"):
            inside = [f"{folder}/{name}" for name in manifests.listed(spark, f"{root}/{folder}")]
            gone += [folder] if not live & set(inside) else [name for name in inside if name.endswith(".parquet") and name not in live]
    manifests.delete(spark, root, gone)
    return sorted(gone)

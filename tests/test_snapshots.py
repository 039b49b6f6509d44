"""Write-back: untouched files keep name and bytes, a rerun changes nothing, a death halfway loses nothing."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from grainguard.operators import governance as G
from grainguard.plans import shapes
from grainguard.session import new_folder
from grainguard.sources import snapshots
from grainguard.sources.snapshots import ACTION, DROP, KEEP

KEPT = "id long, user_id long, category string, plan string, created_at timestamp_ntz"
AS_OF = "2024-06-01 00:00:00"


def rows(spark, n=400):
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 50 END AS user_id",
        "CASE WHEN id % 10 < 8 THEN 'logs' WHEN id % 10 = 8 THEN 'other' END AS category", "'free' AS plan",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id div 2 as int)) AS created_at",
    )


def contents(root):
    return {p[len(root) + 1 :]: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{root}/files-*/*.parquet")}


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_files_with_old_rows_are_rewritten(spark):
    root, df = new_folder(spark, "t"), rows(spark)
    snapshots.create(df.repartitionByRange(10, "created_at"), root)
    before, bytes_before = snapshots.files_of(spark, root), contents(root)
    holds = spark.createDataFrame([(3,), (3,), (None,)], "user_id long")
    done = G.purge_table(spark, root, holds, AS_OF)
    want = G.retention_purge(df, holds, AS_OF).where("action = 'keep'").select(df.columns)
    assert sorted_rows(snapshots.read(spark, root)) == sorted_rows(want) and want.count() < 400
    after, bytes_after = snapshots.files_of(spark, root), contents(root)
    kept = set(before) & set(after)
    assert 0 < done["rewritten"] < len(before) and done["kept"] == len(kept) == len(before) - done["rewritten"]
    assert all(bytes_before[f] == bytes_after[f] for f in before)  # the old ones too, for readers of the first manifest
    again = G.purge_table(spark, root, holds, AS_OF)
    assert again == {"version": done["version"], "rewritten": 0, "kept": len(after)}
    assert contents(root) == bytes_after and snapshots.files_of(spark, root) == after
    gone = snapshots.vacuum(spark, root)
    assert gone and sorted_rows(snapshots.read(spark, root)) == sorted_rows(want)
    assert set(contents(root)) == set(after) and {f: bytes_after[f] for f in kept} == {f: contents(root)[f] for f in kept}


def test_a_death_before_the_manifest(spark, monkeypatch):
    root, df = new_folder(spark, "t"), rows(spark, 50)
    snapshots.create(df.repartition(3, "id"), root)
    files = snapshots.files_of(spark, root)

    def change(r):
        return r.withColumn(ACTION, F.when(F.col("id") < 10, DROP).otherwise(KEEP))

    def dies(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(snapshots.manifests, "publish", dies)
        snapshots.write_back(spark, root, change)
    assert snapshots.files_of(spark, root) == files and snapshots.read(spark, root).count() == 50
    snapshots.write_back(spark, root, change)
    assert snapshots.read(spark, root).count() == 40
    snapshots.vacuum(spark, root)
    assert snapshots.read(spark, root).count() == 40 and set(contents(root)) == set(snapshots.files_of(spark, root))


def test_everything_goes_and_empty_tables(spark):
    root = new_folder(spark, "t")
    snapshots.create(rows(spark, 20), root)
    snapshots.write_back(spark, root, lambda r: r.withColumn(ACTION, F.lit(DROP)))
    left = snapshots.read(spark, root)
    assert left.count() == 0 and left.columns == rows(spark, 1).columns
    assert snapshots.write_back(spark, root, lambda r: r.withColumn(ACTION, F.lit(DROP)))["rewritten"] == 0
    with pytest.raises(ValueError):
        snapshots.create(rows(spark, 1), root)


def test_erasing_in_three_tables(spark):
    made = {
        "runs": spark.range(300).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id div 10 END AS user_id"),
        "finds": spark.range(900).selectExpr("id div 3 AS run_id", "id AS seq"),
        "audit": spark.range(200).selectExpr("id", "id div 5 AS user_id", "'x' AS kind"),
    }
    roots = {name: new_folder(spark, name) for name in made}
    for name, df in made.items():
        snapshots.create(df.repartitionByRange(6, df.columns[0]), roots[name])
    requests = spark.createDataFrame([(2,), (2,), (3,), (None,)], "user_id long")
    tables = {"runs": ("delete", roots["runs"], "user_id"), "finds": ("cascade", roots["finds"], "run_id", "runs", "id"), "audit": ("anonymise", roots["audit"], "user_id")}
    want = G.erase_accounts({n: (how, made[n], *more) for n, (how, _, *more) in tables.items()}, requests, AS_OF)
    done = G.erase_from_tables(spark, tables, requests)
    for name in made:
        assert sorted_rows(snapshots.read(spark, roots[name])) == sorted_rows(want[name])
        assert done[name]["rewritten"] >= 1 and done[name]["kept"] >= 3
    again = G.erase_from_tables(spark, tables, requests)
    assert all(again[name]["rewritten"] == 0 for name in made)
    assert os.path.isdir(roots["audit"])


@pytest.mark.parametrize("hot", [False, True])
def test_erasing_in_as_many_tasks_as_rows_ask_for(spark, monkeypatch, request, hot):
    """Rows whose columns compress well are not put into a few large tasks; a task that a key would fill is left to the engine."""
    if hot:
        request.getfixturevalue("every_key_hot")
    monkeypatch.setattr(shapes, "TASK_ROWS", 100)
    monkeypatch.setattr(shapes.is_small, "__defaults__", (0,))
    made = {"runs": spark.range(3000).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 500 END AS user_id"), "finds": spark.range(5000).selectExpr("id % 3500 AS run_id", "id AS seq")}
    roots = {name: new_folder(spark, name) for name in made}
    for name, df in made.items():
        snapshots.create(df.repartition(5), roots[name])
    requests = spark.range(0, 500, 2).selectExpr("id AS user_id")
    tables = {"runs": ("delete", roots["runs"], "user_id"), "finds": ("cascade", roots["finds"], "run_id", "runs", "id")}
    want = G.erase_accounts({n: (how, made[n], *more) for n, (how, _, *more) in tables.items()}, requests, AS_OF)
    seen, join = [], shapes.dealt
    monkeypatch.setattr(G, "dealt", lambda *args: seen.append(join(*args)) or seen[-1])
    G.erase_from_tables(spark, tables, requests)
    for name in made:
        assert sorted_rows(snapshots.read(spark, roots[name])) == sorted_rows(want[name])
    assert all(("RepartitionByExpression" in rows._jdf.queryExecution().analyzed().toString()) != hot for rows, _ in seen)


def test_a_row_carries_a_number_for_its_file(spark):
    root = new_folder(spark, "t")
    snapshots.create(rows(spark, 100).repartition(4, "id"), root)
    carried = []

    def change(r):
        carried.append(r.schema[snapshots.FILE].dataType.typeName())
        return r.withColumn(ACTION, F.when(F.col("id") == 1, DROP).otherwise(KEEP))

    done = snapshots.write_back(spark, root, change)
    assert carried == ["long", "long"] and done["rewritten"] == 1 and done["kept"] == 3
    assert sorted(r["id"] for r in snapshots.read(spark, root).collect()) == [0, *range(2, 100)]

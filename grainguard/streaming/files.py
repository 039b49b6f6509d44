"""File sources and sinks of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_files(
    spark: SparkSession,
    schema: str,
    folder: str,
    pattern: str,
    bytes_per_trigger: int = 4 * 2**30,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of parquet files; the trigger limit bounds the rows, and so the memory, of one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder)


def run_batches(df: DataFrame, out: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all data there is, ``write`` taking each micro-batch.

    State lives in RocksDB, outside the heap. The stream's own checkpoint lies in ``out``.
    """
    spark = df.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{out}/checkpoint")
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def run_available(
    df: DataFrame, out: str, mode: str, prepare: Callable[[DataFrame, int], DataFrame] = lambda batch, batch_id: batch
) -> str:
    """Run a stream over all data there is and write what ``prepare`` makes of each micro-batch to ``out``.

    A batch goes to its own folder and overwrites it, so a batch repeated after
    a failure leaves no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch, batch_id).write.mode("overwrite").parquet(f"{out}/data/{BATCH}={batch_id}")

    run_batches(df, out, mode, write)
    return f"{out}/data"


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each key, with its batch; versions of later batches win."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def latest_per_key(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Fold an update-mode output: the last version of each key wins."""
    return latest(spark.read.option("basePath", path).parquet(path), keys).drop(BATCH)


def all_batches(spark: SparkSession, path: str) -> DataFrame:
    """Append-mode output: every row once."""
    return spark.read.option("basePath", path).parquet(path).drop(BATCH)

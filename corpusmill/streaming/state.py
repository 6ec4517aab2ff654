"""Streams whose result is their state: one record per key, kept in RocksDB and read from there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on disk, not in the heap of executors."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_changes(state: DataFrame, checkpoint: str, changes: Callable[[DataFrame, int], None] | None = None) -> None:
    """Bring the state up to date with all that is there, and stop.

    ``state`` is a streaming aggregation: per key of a micro-batch it puts out the new
    record, which ``changes`` may store. A batch that is replayed after a failure has the same
    number and the same rows. Equal keys are merged in the tasks that read them, so that a
    hot key arrives as one partial record per task.
    """

    def pass_on(batch: DataFrame, batch_id: int) -> None:
        if changes is not None:
            changes(batch, batch_id)
        else:
            batch.write.format("noop").mode("overwrite").save()

    with rocksdb_state(state.sparkSession):
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(pass_on)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str, columns: list[str]) -> DataFrame:
    """One row per key of an aggregation's state: its keys, and its aggregates named ``columns`` in order."""
    stored = spark.read.format("statestore").load(checkpoint)
    values = stored.schema["value"].dataType.names
    if len(values) != len(columns):
        raise ValueError(f"the state holds {values}")
    return stored.select("key.*", *[F.col("value")[v].alias(c) for v, c in zip(values, columns)])


def changes_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for change rows: every micro-batch owns a folder and replaces it when replayed."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return store

"""Stage boundaries and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session, as in tests, may fall back to the machine's own folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.gettempdir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in the part that belongs to this application."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all stage tables of this application; results built on them are gone too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    The table cuts the lineage and survives lost executors; every later read sees the
    same rows, reads only the columns it needs, and knows their size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` as a lookup to broadcast if it has at most ``max_rows`` rows, else unchanged.

    The check fetches no more than ``max_rows + 1`` rows; a larger side is left to an
    ordinary shuffled join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of narrow rows, to broadcast if it has at most ``max_rows``.

    A larger one stays as it is and is joined by a shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

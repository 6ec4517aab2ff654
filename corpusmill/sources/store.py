"""Tables that are replaced in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, keep: str = ".bak") -> str:
    """Write ``df``, which may read the table at ``path``, and put it in that table's place.

    The new table is written whole beside the old one, then two renames swap them: readers
    see the old or the new table, never a part, and a write that fails leaves the old one. The
    old table is kept under ``path`` and ``keep``, the one kept before is deleted. Returns its path.
    """
    spark = df.sparkSession
    plain = path.rstrip("/")
    fresh, kept = f"{plain}.new-{uuid.uuid4().hex}", plain + keep
    files, at = _filesystem(spark, plain), spark._jvm.org.apache.hadoop.fs.Path
    df.write.parquet(fresh)
    there = files.exists(at(plain))
    if there:
        files.delete(at(kept), True)
        if not files.rename(at(plain), at(kept)):
            raise OSError(f"cannot move {plain} aside; the new table is {fresh}")
    if not files.rename(at(fresh), at(plain)):
        if there:
            files.rename(at(kept), at(plain))
        raise OSError(f"cannot move {fresh} to {plain}")
    spark.catalog.refreshByPath(plain)
    return kept

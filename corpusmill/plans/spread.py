"""Parallelism for scans with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """``scan`` over all cores, if its files give fewer splits than there are cores.

    Costly work per row would otherwise run in one task on a file with one row group.
    Large tables have more splits than cores and are left alone. ``keys`` should tell
    rows apart, so that no value collects many of them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)

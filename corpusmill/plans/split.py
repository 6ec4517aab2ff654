"""Seeded stratified split that never sorts a whole class in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.materialize import small_lookup

BUCKET_DIGITS = 4


def seeded_hash(id_col: str, seed: int) -> Column:
    """Order of IDs that depends on the seed and the ID only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_counts(df: DataFrame, keys: Sequence[str], label: str, id_col: str, seed: int) -> DataFrame:
    """(group, label, hash, n): how many rows each distinct ID has in its class.

    Equal IDs are counted in the tasks that read them, so one with a third of all rows is a
    single line. The table can be stored and joined by ``merge_hash_counts`` with later rows.
    """
    cell = [*keys, label]
    hashed = df.select(*cell, seeded_hash(id_col, seed).alias("hash"))
    return hashed.groupBy(*cell, "hash").agg(F.count("*").alias("n"))


def merge_hash_counts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts of stored and fresh rows together; the stored rows themselves are not read again."""
    cell = [c for c in stored.columns if c != "n"]
    return stored.unionByName(fresh).groupBy(*cell).agg(F.sum("n").alias("n"))


def cuts_of_counts(counts: DataFrame, keys: Sequence[str], label: str, test_size: float) -> DataFrame:
    """Last test hash of every class: one row per group and label that has test rows.

    ``counts`` are those of ``hash_counts``, or rows that each count 1. Counts per hash prefix
    locate the prefix in which the quota is reached; only the hashes of that prefix (1 in
    65,536) are ranked, each as one line of its count, however many rows an ID has.
    """
    cell = [*keys, label]
    prefix = F.substring("hash", 1, BUCKET_DIGITS)
    histogram = counts.groupBy(*cell, prefix.alias("_bucket")).agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy(*cell).orderBy("_bucket")
    quota = F.bround(F.sum("_n").over(Window.partitionBy(*cell)) * F.lit(test_size)).cast("bigint")
    filled = histogram.withColumns({"_upto": F.sum("_n").over(upto), "_quota": quota})
    edge = small_lookup(
        filled.where("_quota > 0 and _upto >= _quota and _upto - _n < _quota").select(
            *cell, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_take")
        )
    )
    before = F.sum("n").over(Window.partitionBy(*cell).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    return (
        counts.withColumn("_bucket", prefix)
        .join(edge, [*cell, "_bucket"])
        .groupBy(*cell, "_take", "hash")
        .agg(F.sum("n").alias("n"))
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .where("_before < _take and _before + n >= _take")
        .select(*cell, F.col("hash").alias("cut"))
    )


def split_cuts(
    df: DataFrame, keys: Sequence[str], label: str, id_col: str, test_size: float, seed: int
) -> DataFrame:
    """Last test hash of every class of ``df``."""
    each = df.select(*keys, label, seeded_hash(id_col, seed).alias("hash"), F.lit(1).cast("bigint").alias("n"))
    return cuts_of_counts(each, keys, label, test_size)


def split_by_cuts(df: DataFrame, cuts: DataFrame, keys: Sequence[str], label: str, id_col: str, seed: int) -> DataFrame:
    """Add ``split`` by the cut of each row's class; a class without a cut is all train."""
    cell = [*keys, label]
    is_test = seeded_hash(id_col, seed) <= F.col("cut")
    return (
        df.join(small_lookup(cuts), cell, "left")
        .withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
        .select(*df.columns, "split")
    )


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    id_col: str,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per group and label, ``bround(n * test_size)`` rows are test.

    Rows with the same ID fall on the same side. The rows themselves are not shuffled:
    each compares its hash with the cut of its class.
    """
    return split_by_cuts(df, split_cuts(df, keys, label, id_col, test_size, seed), keys, label, id_col, seed)

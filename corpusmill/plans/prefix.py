"""Running totals and exact quantiles over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.materialize import materialize, small_lookup


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Add ``<value>_before`` (sum over earlier rows of the group) for each value column.

    ``order`` must be unique within a group. A window per group would sort a whole
    group in one task, so the rows are range-partitioned by group and order, summed
    inside each slice, and shifted by the totals of the earlier slices. A group as
    large as the table is spread over all tasks.
    """
    sliced = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    in_slice = [*keys, "_slice"]
    inside = Window.partitionBy(*in_slice).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    totals = sliced.groupBy(*in_slice).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    shifts = totals.select(
        *in_slice, *[F.coalesce(F.sum(f"_{v}").over(slices), F.lit(0)).alias(f"_{v}_shift") for v in values]
    )
    local = sliced.withColumns(
        {f"_{v}_local": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    return local.join(shifts, in_slice).select(
        *df.columns, *[(F.col(f"_{v}_local") + F.col(f"_{v}_shift")).alias(f"{v}_before") for v in values]
    )


def dense_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the place of each row in its group, from 0 without gaps; equal rows are in any order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, keys, [F.col(c) for c in order], ["_one"])
    return ranked.select(*df.columns, F.col("_one_before").cast("bigint").alias(name))


def value_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, exact median, smallest and largest ``value`` per group.

    Works on a histogram of distinct values, so no task holds all values of a group.
    """
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_totals(histogram, keys, [F.col(value)], ["n"])
    if keys:
        sizes = small_lookup(ranked.groupBy(*keys).agg(F.sum("n").alias("_total")))
        ranked = ranked.join(sizes, list(keys))
    else:
        ranked = ranked.withColumn("_total", F.lit(ranked.agg(F.sum("n")).first()[0]))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def at(position: Column) -> Column:
        holds = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(holds, F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        ((at(low) + at(high)) / 2).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )

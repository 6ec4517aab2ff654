"""Row numbers of a table read from files, in file order, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.materialize import materialize


def number_parquet_rows(scan: DataFrame, name: str = "metadata_row", first: int = 2) -> DataFrame:
    """Position of each row of a Parquet scan, files in path order.

    The reader knows the position inside a file; several files are shifted by the row
    counts of the earlier ones, which is one small row per file.
    """
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(scan.inputFiles()) == 1:
        return scan.select("*", (index + F.lit(first)).alias(name))
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        scan.groupBy(path.alias("_path"))
        .agg(F.count("*").alias("_n"))
        .select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    numbered = scan.select("*", path.alias("_path"), index.alias("_index"))
    return numbered.join(shifts, "_path").select(
        *scan.columns, (F.col("_shift") + F.col("_index") + F.lit(first)).alias(name)
    )


def number_text_rows(scan: DataFrame, name: str = "metadata_row", first: int = 2) -> DataFrame:
    """Position of each row of a CSV or JSON scan, files in path order.

    Rows of one split are numbered as read; splits are shifted by the row counts of
    the earlier ones. The scan is materialized once so that both steps see the same
    splits.
    """
    read = materialize(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        read.groupBy("_path", "_start")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_id0"))
        .select("_path", "_start", "_id0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return read.join(shifts, ["_path", "_start"]).select(
        *scan.columns, (F.col("_shift") + F.col("_id") - F.col("_id0") + F.lit(first)).alias(name)
    )

"""ID lists: one per line, ``#`` starts a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct IDs of a list file or folder."""
    line = strip(F.substring_index("value", "#", 1))
    return spark.read.text(path).select(line.alias("file_id")).where("file_id <> ''").distinct()


def exclusion_lines(df: DataFrame, reasons: str = "reasons", loop: str = "out_loop") -> DataFrame:
    """``<id>  # <reasons>  loop=<percent>`` lines, sorted by ID."""
    percent = F.bround(F.col(loop) * 100).cast("int").cast("string")
    line = F.concat(
        F.col("file_id").cast("string"), F.lit("  # "), F.array_join(reasons, ","), F.lit("  loop="), percent, F.lit("%")
    )
    return df.orderBy("file_id").select(line.alias("value"))


def write_id_list(df: DataFrame, path: str, mode: str = "errorifexists", **columns: str) -> None:
    """Write ``exclusion_lines`` as text files in ID order."""
    exclusion_lines(df, **columns).write.mode(mode).text(path)

"""Text files against metadata rows, by ID."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ids import extract_file_id, normalize_id


def with_file_id(files: DataFrame, suffix: str) -> DataFrame:
    """File names with their ID; blank for names without one."""
    return files.withColumn("file_id", extract_file_id("text_file", suffix))


def valid_files(files: DataFrame) -> DataFrame:
    return files.where("file_id <> ''")


def invalid_files(files: DataFrame) -> DataFrame:
    return files.where("file_id = ''")


def explode_ids(meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """One row per valid ID of each cell; an ID listed twice counts twice."""
    tokens = meta.select("*", F.explode(F.split(cell, ",")).alias("_token"))
    return tokens.withColumn("file_id", normalize_id("_token")).where("file_id <> ''").drop("_token")


def metadata_ids(meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """Distinct IDs of the metadata."""
    return explode_ids(meta.select(cell), cell).select("file_id").distinct()


def match_files(files: DataFrame, meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """Every file with every metadata row that lists its ID.

    A plain equi-join: the output holds each pair by definition, and adaptive execution
    splits a hot ID over several tasks.
    """
    return valid_files(files).join(explode_ids(meta, cell), "file_id")


def files_with_metadata(files: DataFrame, meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """Files whose ID occurs in the metadata, each once."""
    return valid_files(files).join(metadata_ids(meta, cell), "file_id", "left_semi")


def unmatched_files(
    files: DataFrame, meta: DataFrame, cell: str = "matched_ids", reason: str = "no_metadata_match"
) -> DataFrame:
    """Files without metadata and files without a valid ID, with the reason."""
    strangers = valid_files(files).join(metadata_ids(meta, cell), "file_id", "left_anti")
    return (
        invalid_files(files)
        .select("text_file", "file_id", F.lit("invalid_filename_id").alias("reason"))
        .unionByName(strangers.select("text_file", "file_id", F.lit(reason).alias("reason")))
    )


def match_summary(files: DataFrame, meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """One row of counts; files and distinct IDs are counted separately."""
    rows_per_id = explode_ids(meta.select(cell), cell).groupBy("file_id").agg(F.count("*").alias("n_rows"))
    files_per_id = files.groupBy("file_id").agg(F.count("*").alias("n_files"))
    ids = files_per_id.join(rows_per_id, "file_id", "full_outer").select(
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.col("file_id") == "").alias("invalid"),
    )

    def total(value, condition):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    n_files, n_rows, bad = F.col("n_files"), F.col("n_rows"), F.col("invalid")
    known = (n_files > 0) & (n_rows > 0) & ~bad
    unknown = (n_files > 0) & (n_rows == 0) & ~bad
    return ids.agg(
        total(n_files, F.lit(True)).alias("files_scanned"),
        total(n_files, bad).alias("files_invalid"),
        total(n_files, ~bad).alias("files_valid"),
        total(n_files, known).alias("files_matched"),
        total(n_files, unknown).alias("files_unmatched"),
        F.count_if(n_rows > 0).alias("ids_in_metadata"),
        F.count_if(known).alias("ids_matched"),
        F.count_if(unknown).alias("ids_unmatched"),
        F.count_if(known & (n_rows > 1)).alias("ids_with_many_rows"),
        total(n_files * n_rows, known).alias("output_rows"),
    )

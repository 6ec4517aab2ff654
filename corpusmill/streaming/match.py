"""Files matched against metadata as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.matching import explode_ids, metadata_ids, valid_files, with_file_id
from corpusmill.plans.materialize import materialize


def stored_rows(meta: DataFrame) -> DataFrame:
    """The metadata rows by ID, unfolded and written once: every micro-batch reads this table."""
    return materialize(explode_ids(meta))


def stored_ids(meta: DataFrame) -> DataFrame:
    """The distinct IDs of the metadata, written once."""
    return materialize(metadata_ids(meta))


def stream_match(names: DataFrame, meta: DataFrame, suffix: str, rows: DataFrame | None = None) -> DataFrame:
    """A stream of file names joined with the static metadata rows of their IDs.

    ``rows`` are those of ``stored_rows``, where they are at hand already.
    """
    return valid_files(with_file_id(names, suffix)).join(stored_rows(meta) if rows is None else rows, "file_id")


def stream_unmatched(names: DataFrame, meta: DataFrame, suffix: str, ids: DataFrame | None = None) -> DataFrame:
    """A stream of the names without metadata or without a valid ID, with the reason.

    ``ids`` are those of ``stored_ids``, where they are at hand already.

    Names without an ID probe with their own name, which is no ID: a single blank key
    would send them all to one task.
    """
    blank = F.col("file_id") == ""
    files = with_file_id(names, suffix).withColumn(
        "_probe", F.when(blank, F.concat(F.lit("#"), "text_file")).otherwise(F.col("file_id"))
    )
    known = (stored_ids(meta) if ids is None else ids).select(F.col("file_id").alias("_probe"), F.lit(True).alias("_known"))
    reason = F.when(blank, "invalid_filename_id").otherwise("no_metadata_match")
    joined = files.join(known, "_probe", "left").where("_known is null")
    return joined.select("text_file", "file_id", reason.alias("reason"))


def run_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process all files that are there and stop; the checkpoint skips them next time."""
    query = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

"""Files whose metadata rows agree, while files and metadata rows are still landing.

The state holds one record per ID: how many metadata rows it has, and the smallest and the
largest label tuple among them. They agree while both are the same; a late row with other
labels makes them differ and so withdraws the files of the ID.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.labels import clean_labels
from corpusmill.operators.matching import explode_ids, valid_files
from corpusmill.streaming.state import changes_folder, read_state, run_changes

STATE = ["n_metadata_rows", "_low", "_high"]


def _with_verdict(ids: DataFrame) -> DataFrame:
    return ids.withColumn("usable", F.col("_low").eqNullSafe(F.col("_high")))


def run_agreement(
    meta: DataFrame,
    labels: Sequence[str],
    checkpoint: str,
    cell: str = "matched_ids",
    strip_values: bool = True,
    changes: str | None = None,
) -> None:
    """Count all new metadata rows into the state.

    ``changes`` is a folder for the new standing of every ID that a micro-batch touched: its
    labels with ``usable`` true, or NULL labels with ``usable`` false, which withdraws what
    was said of it before. The last standing of each ID gives the state again.
    """
    rows = explode_ids(clean_labels(meta.select(cell, *labels), labels, strip_values), cell)
    tuple_ = F.struct(*labels)
    state = rows.groupBy("file_id").agg(
        F.count("*").alias("n_metadata_rows"), F.min(tuple_).alias("_low"), F.max(tuple_).alias("_high")
    )
    kept = F.when(F.col("usable"), F.col("_low"))
    standing = _with_verdict(state).select("file_id", "n_metadata_rows", "usable", kept.alias("_kept")).select(
        "file_id", "n_metadata_rows", "usable", "_kept.*"
    )
    run_changes(standing, checkpoint, changes_folder(changes) if changes else None)


def current_agreement(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file_id, n_metadata_rows, n labels agree as ``usable``, the labels as ``_labels``) of every ID so far."""
    ids = _with_verdict(read_state(spark, checkpoint, STATE))
    return ids.select("file_id", "n_metadata_rows", "usable", F.when(F.col("usable"), F.col("_low")).alias("_labels"))


def current_usable(files: DataFrame, checkpoint: str) -> DataFrame:
    """What ``usable_matches`` gives for the files and all metadata rows so far.

    ``files`` is what has landed of them, in any order to the metadata.
    """
    agreed = current_agreement(files.sparkSession, checkpoint).where("usable")
    kind = F.when(F.col("n_metadata_rows") == 1, "single_row").otherwise("multi_row_identical")
    return valid_files(files).join(agreed, "file_id").select(
        "text_file", "file_id", "n_metadata_rows", kind.alias("match_type"), "_labels.*"
    )


def current_counts(files: DataFrame, checkpoint: str) -> DataFrame:
    """One row: files with one or several metadata rows, and of the latter those that agree or conflict."""
    per_id = valid_files(files).groupBy("file_id").agg(F.count("*").alias("_files"))
    known = per_id.join(current_agreement(files.sparkSession, checkpoint), "file_id")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_files"))), F.lit(0)).cast("bigint")

    many = F.col("n_metadata_rows") > 1
    return known.agg(
        total(~many).alias("single_row"),
        total(many).alias("multiple_rows"),
        total(many & F.col("usable")).alias("identical"),
        total(many & ~F.col("usable")).alias("conflicting"),
    )

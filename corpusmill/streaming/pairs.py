"""Checks on text pairs as they land, kept by ID with the last record winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.quality import DEFAULT_RULES, QualityRules
from corpusmill.operators.quality import check_pairs
from corpusmill.streaming.state import changes_folder, read_state, run_changes


def run_pair_checks(
    pairs: DataFrame,
    path: str,
    checkpoint: str,
    rules: QualityRules = DEFAULT_RULES,
    id_col: str = "file_id",
    order: str = "seq",
    changes: str | None = None,
) -> None:
    """Check all new pairs and keep the last record of each ID.

    The later micro-batch wins, inside one the larger ``order``; of equal ones the largest
    record. The records are the state of the stream, one per ID however often it landed;
    ``path`` names their place for ``current_pairs``. ``changes`` is a folder for the records
    that each micro-batch has put in.
    """
    spark = pairs.sparkSession
    checked = check_pairs(pairs, rules=rules).drop("src", "out")
    rest = [c for c in checked.columns if c not in (id_col, order)]
    # The time of a micro-batch is logged with it, so a replay keeps its order.
    landed = checked.withColumn("_landed", F.current_timestamp())
    last = landed.groupBy(id_col).agg(F.max(F.struct("_landed", order, *rest)).alias("last"))
    sink = changes_folder(changes) if changes else None
    run_changes(last.select(id_col, "last.*").drop("_landed"), checkpoint, sink)
    spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1).write.mode("overwrite").parquet(path)


def current_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Last record of each ID over all micro-batches."""
    checkpoint = spark.read.parquet(path).first().checkpoint
    state = read_state(spark, checkpoint, ["last"])
    ids = [c for c in state.columns if c != "last"]
    return state.select(*ids, "last.*").drop("_landed")

"""Run folders with predictions, and shared summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.sources.corpus import plain_path

PREDICTION_SCHEMA = (
    "file_id STRING, `true` INT, pred INT, pred_greedy INT, p_yes DOUBLE, p_pos DOUBLE, raw_output STRING"
)
RUN_SCHEMA = "task STRING, base_model STRING, model STRING"


def _folder() -> F.Column:
    return plain_path(F.regexp_extract(F.col("_metadata.file_path"), r"(?s)\A(.*)/[^/]*\z", 1))


def read_runs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Predictions of every run folder that has them, with the run's task and model.

    ``folders`` may hold globs; folders without ``predictions.jsonl`` add nothing.
    """
    lines = (
        spark.read.schema(PREDICTION_SCHEMA)
        .option("pathGlobFilter", "predictions.jsonl")
        .json(folders)
        .select("*", _folder().alias("run"))
    )
    infos = (
        spark.read.schema(RUN_SCHEMA)
        .option("pathGlobFilter", "metrics.json")
        .option("multiLine", True)
        .json(folders)
        .select(_folder().alias("run"), "task", F.coalesce("base_model", "model").alias("model"))
    )
    return lines.join(infos, "run", "left").select(
        "run",
        "model",
        "task",
        "file_id",
        F.col("true").alias("y_true"),
        F.col("pred").alias("y_pred"),
        F.coalesce("p_yes", "p_pos").alias("p_yes"),
        "raw_output",
    )


def append_summary(df: DataFrame, path: str) -> None:
    """Append metric rows to a CSV summary.

    An existing summary keeps its columns: new ones are dropped, missing ones stay empty.
    """
    spark = df.sparkSession
    try:
        columns = spark.read.csv(path, header=True).columns
    except AnalysisException:
        columns = []
    columns = columns or df.columns
    aligned = df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )
    aligned.write.mode("append").csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)

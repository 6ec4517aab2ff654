"""Task datasets: JSON lines, JSON arrays, partitioned task/split folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_split(
    spark: SparkSession, path: str | list[str], array: bool = False, schema: StructType | str | None = None
) -> DataFrame:
    """JSON lines, or files that each hold one JSON array; ``text`` falls back to ``input``."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path, multiLine=array)
    if "input" not in df.columns:
        return df
    if "text" in df.columns:
        return df.withColumn("text", F.coalesce("text", "input"))
    return df.withColumn("text", F.col("input"))


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per task: an array file could not be written in parallel."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_tasks(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """``<path>/task=…/split=…`` folders; large tasks are spread over several files."""
    balanced = df.hint("rebalance", F.col("task"), F.col("split"))
    balanced.write.mode(mode).partitionBy("task", "split").format(fmt).save(path)


def read_tasks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All task folders; a filter on ``task`` or ``split`` prunes folders."""
    return spark.read.format(fmt).load(path)


MANIFEST_SCHEMA = """`group` STRING, components ARRAY<STRING>, n_kept BIGINT, n_dropped_undetermined BIGINT, n_excluded BIGINT,
    exclusion_list STRING, test_size DOUBLE, seed INT, excluded_file_ids ARRAY<STRING>,
    splits STRUCT<train: ARRAY<STRING>, test: ARRAY<STRING>>"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents, one row per ID with its section and place beside the group's figures."""
    documents = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)

    def section(name: str, ids: str) -> DataFrame:
        return documents.select(
            "group", "components", "n_kept", "n_dropped_undetermined", "n_excluded", "exclusion_list", "test_size", "seed",
            F.lit(name).alias("section"), F.posexplode(ids).alias("position", "file_id"),
        )

    return section("excluded", "excluded_file_ids").unionByName(section("train", "splits.train")).unionByName(section("test", "splits.test"))

"""Checks that stop a build: each is a query for violations, empty when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.digests import FAN_OUT, LEVELS, bucket_of, differing_buckets, digest_tree


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not df.columns:
        raise ValueError("the table has no header")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def require_rows(df: DataFrame, message: str = "no rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise with up to ``show`` examples unless there is no violation."""
    examples = violations.limit(show).collect()
    if examples:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in examples))


def split_overlap(rows: DataFrame, keys: Sequence[str] = ("task",), id_col: str = "file_id") -> DataFrame:
    """IDs that are in both splits of one task."""
    train = rows.where("split = 'train'").select(*keys, id_col)
    test = rows.where("split = 'test'").select(*keys, id_col)
    return train.intersect(test)


def cross_task_leak(rows: DataFrame, id_col: str = "file_id") -> DataFrame:
    """IDs in the train split of one task and the test split of another, with both task lists.

    Tasks are a fixed registry, so the lists are short.
    """

    def tasks(split: str):
        return F.array_sort(F.collect_set(F.when(F.col("split") == split, F.col("task"))))

    per_id = rows.groupBy(id_col).agg(tasks("train").alias("train"), tasks("test").alias("test"))
    other = F.size(F.array_union("train", "test")) > 1
    return per_id.where((F.size("train") > 0) & (F.size("test") > 0) & other).select(
        id_col,
        F.array_join("train", ",").alias("train_tasks"),
        F.array_join("test", ",").alias("test_tasks"),
    )


def missing_pairs(rows: DataFrame, pairs: DataFrame, id_col: str = "file_id") -> DataFrame:
    """IDs of dataset rows without a counterpart text."""
    return rows.select(id_col).distinct().join(pairs.select(id_col), id_col, "left_anti")


def text_conflicts(rows: DataFrame, id_col: str = "file_id", text: str = "text") -> DataFrame:
    """IDs that come with more than one text; digests are compared, not whole texts."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return (
        rows.select(id_col, digest.alias("_digest"))
        .groupBy(id_col)
        .agg(F.count_distinct("_digest").alias("n_texts"))
        .where("n_texts > 1")
    )


def label_map_diff(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("file_id", "task"),
    left_tree: DataFrame | None = None,
    right_tree: DataFrame | None = None,
) -> DataFrame:
    """Keys or labels on which two label tables disagree.

    Digest trees of both sides tell the buckets of keys that differ, and only their rows are
    joined; equal tables are not joined at all. Trees that are stored with the tables may be given.
    """
    trees = [
        digest_tree(side.select(*keys, "label"), keys) if tree is None else tree
        for side, tree in ((left, left_tree), (right, right_tree))
    ]
    buckets = differing_buckets(*trees)
    if not buckets:
        return left.select(*keys, F.col("label").alias("left_label"), F.col("label").alias("right_label")).limit(0)
    here = bucket_of(keys).isin(buckets) if len(buckets) < FAN_OUT**LEVELS else F.lit(True)
    joined = (
        left.where(here)
        .select(*keys, F.col("label").alias("left_label"))
        .withColumn("_left", F.lit(True))
        .join(
            right.where(here).select(*keys, F.col("label").alias("right_label")).withColumn("_right", F.lit(True)),
            list(keys),
            "full_outer",
        )
    )
    agree = F.col("_left").eqNullSafe(F.col("_right")) & F.col("left_label").eqNullSafe(F.col("right_label"))
    return joined.where(~agree).select(*keys, "left_label", "right_label")


def summary_violations(
    summary: DataFrame,
    expected_tasks: Sequence[str],
    expected_runs: Sequence[Sequence[str]] = (),
    keys: Sequence[str] = ("model",),
) -> DataFrame:
    """Tasks that a run's summary holds more than once, or lacks.

    Every run that occurs must hold all tasks, and so must the ``expected_runs`` (values of
    ``keys``), which need not occur at all.
    """
    counts = summary.groupBy(*keys, "task").agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select(*keys, "task", F.lit("duplicate").alias("problem"))
    runs = counts.select(*keys)
    if expected_runs:
        names = summary.sparkSession.createDataFrame([tuple(r) for r in expected_runs], runs.schema)
        runs = runs.unionByName(names)
    tasks = F.explode(F.array(*[F.lit(t) for t in sorted(set(expected_tasks))])).alias("task")
    lacking = runs.distinct().select(*keys, tasks).join(counts.select(*keys, "task"), [*keys, "task"], "left_anti")
    return repeated.unionByName(lacking.select(*keys, "task", F.lit("missing").alias("problem")))

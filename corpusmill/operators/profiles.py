"""Label distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.labels import BINARY_CELLS, cell_text
from corpusmill.functions.numbers import percent
from corpusmill.functions.text import blank_as


def label_distribution(
    df: DataFrame, labels: Sequence[str], blank: str = "<blank>", ordered: bool = True
) -> DataFrame:
    """Count and percent of each value of each label column, by falling count."""
    values = df.select(*[blank_as(c, blank).alias(c) for c in labels]).unpivot(
        [], list(labels), "prediction_column", "label_value"
    )
    counts = values.groupBy("prediction_column", "label_value").agg(F.count("*").alias("count"))
    # One row per label column, so a broadcast has a bound; a window would gather all values of a column.
    totals = counts.groupBy("prediction_column").agg(F.sum("count").alias("_total"))
    share = percent(F.col("count"), F.col("_total")).alias("percent")
    out = counts.join(F.broadcast(totals), "prediction_column").select(*counts.columns, share)
    return out.orderBy("prediction_column", F.desc("count"), "label_value") if ordered else out


def modal_label(df: DataFrame, labels: Sequence[str], blank: str = "<blank>") -> DataFrame:
    """Most frequent value of each label column; the smaller value wins a tie."""
    counts = label_distribution(df, labels, blank, ordered=False)
    order = F.struct((-F.col("count")).alias("c"), "label_value")
    best = counts.groupBy("prediction_column").agg(
        F.min_by(F.struct("label_value", "count", "percent"), order).alias("_best")
    )
    return best.select("prediction_column", "_best.*")


def complete_binary_rows(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows whose labels are all TRUE or FALSE."""
    condition = F.lit(True)
    for c in labels:
        condition = condition & cell_text(c).isin(*BINARY_CELLS)
    return df.where(condition)

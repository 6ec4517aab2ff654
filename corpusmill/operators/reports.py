"""Result tables for people: flat metric rows, run comparisons, experiment arms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numbers import percent, prevalence, python_round
from corpusmill.operators.metrics import (
    classification_metrics,
    confusion_metrics,
    decide,
    rank_metrics,
    reaches,
    with_prior,
)

# Column order of the flat metric rows and the metrics of a result table.
METRIC_COLUMNS = (
    "accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_f1",
    "roc_auc",
    "pr_auc",
    "precision_pos",
    "recall_pos",
    "f1_pos",
    "precision_neg",
    "recall_neg",
    "f1_neg",
)
COUNT_COLUMNS = ("support_pos", "support_neg", "tn", "fp", "fn", "tp")
TABLE_METRICS = ("macro_f1", "recall_pos", "pr_auc", "roc_auc", "accuracy")


def metrics_rows(
    decided: DataFrame, by: Sequence[str] = ("run", "task"), score: str = "p_yes", info: Sequence[str] = ()
) -> DataFrame:
    """One flat row per run with all metrics at four decimals; ``info`` columns are carried along."""
    keys = [*by, *info]
    unparsed = "unparsed" if "unparsed" in decided.columns else None
    scored = classification_metrics(decided, keys, unparsed)
    ranked = rank_metrics(decided, by, score).select(*by, "roc_auc", "pr_auc")
    rounded = {c: python_round(c, 4) for c in METRIC_COLUMNS}
    tail = ["n_unparsed"] if unparsed else []
    joined = scored.join(ranked, list(by)).withColumns(rounded)
    return joined.select(*keys, "n", *METRIC_COLUMNS, *COUNT_COLUMNS, *tail)


def nested_metrics(df: DataFrame, keys: Sequence[str] = ("run", "task")) -> DataFrame:
    """Metrics of ``classification_metrics`` as one nested record per run, for JSON output."""

    def picked(suffix: str, names: Sequence[str]) -> F.Column:
        return F.struct(*[F.col(f"{n}_{suffix}").alias(n) for n in names])

    def average(prefix: str) -> F.Column:
        return F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in ("precision", "recall", "f1")])

    per_class = ("precision", "recall", "f1", "support")
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return df.select(
        *keys,
        "n",
        "n_pred_pos",
        "accuracy",
        F.struct(picked("neg", per_class).alias("negative"), picked("pos", per_class).alias("positive")).alias("per_class"),
        average("macro").alias("macro"),
        average("weighted").alias("weighted"),
        F.struct(F.array(F.lit(0), F.lit(1)).alias("labels"), matrix.alias("matrix")).alias("confusion_matrix"),
    )


def compare_runs(
    base: DataFrame,
    tuned: DataFrame,
    keys: Sequence[str] = ("model", "task"),
    metrics: Sequence[str] = TABLE_METRICS,
) -> DataFrame:
    """Two metric tables side by side, with a mark where the second is strictly better."""
    left = base.select(*keys, *[F.col(m).alias(f"base_{m}") for m in metrics])
    right = tuned.select(*keys, *[F.col(m).alias(f"tuned_{m}") for m in metrics])
    better = [
        F.coalesce(F.col(f"tuned_{m}") > F.col(f"base_{m}"), F.lit(False)).alias(f"better_{m}") for m in metrics
    ]
    return left.join(right, list(keys)).select(
        *keys, *[c for m in metrics for c in (f"base_{m}", f"tuned_{m}")], *better
    )


def results_table(
    summary: DataFrame,
    conditions: Sequence[str],
    keys: Sequence[str] = ("model", "task"),
    condition: str = "condition",
    metrics: Sequence[str] = TABLE_METRICS,
) -> DataFrame:
    """Metrics in percent, one column per condition and metric, with prevalence and marks.

    The last condition gives the prevalence and is marked where it beats the first.
    """
    last, first = conditions[-1], conditions[0]
    picked = [F.max(c).alias(c) for c in (*metrics, "support_pos", "support_neg")]
    wide = summary.groupBy(*keys).pivot(condition, list(conditions)).agg(*picked)
    shown = [
        percent(F.col(f"{c}_{m}"), F.lit(1)).alias(f"{c}_{m}") for c in conditions for m in metrics
    ]
    marks = [
        F.coalesce(F.col(f"{last}_{m}") > F.col(f"{first}_{m}"), F.lit(False)).alias(f"better_{m}")
        for m in metrics
    ]
    share = prevalence(F.col(f"{last}_support_pos"), F.col(f"{last}_support_neg"))
    return wide.select(*keys, share.alias("prevalence"), *shown, *(marks if len(conditions) > 1 else []))


def decision_arms(
    preds: DataFrame,
    train: DataFrame,
    arms: Mapping[str, tuple[str, float | str | None]],
    by: Sequence[str] = ("run", "task"),
    metrics: Sequence[str] = ("macro_f1", "recall_pos", "accuracy"),
) -> DataFrame:
    """Decision rules over the same stored answers and scores, side by side.

    An arm is ``(mode, threshold)``; the threshold ``"prior"`` is the train prior.
    """
    parsed = decide(with_prior(preds, train), "greedy").drop("y_pred")
    # Each row counts in the cells of every arm where it stands; only groups are unfolded by arm.
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    said = {arm: decide_column(mode, threshold) for arm, (mode, threshold) in arms.items()}
    counted = parsed.select(*by, "y_true", F.struct(*[p.alias(arm) for arm, p in said.items()]).alias("_said")).groupBy(*by).agg(
        *[
            F.count_if((F.col("y_true") == true) & (F.col(f"_said.{arm}") == pred)).alias(f"_{arm}_{cell}")
            for arm in said
            for cell, (true, pred) in cells.items()
        ]
    )
    per_arm = counted.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(arm).alias("arm"), *[F.col(f"_{arm}_{c}").alias(c) for c in cells]) for arm in said])),
    )
    return (
        confusion_metrics(per_arm)
        .groupBy(*by)
        .pivot("arm", list(arms))
        .agg(*[F.max(python_round(m, 4)).alias(m) for m in metrics])
    )


def decide_column(mode: str, threshold: float | str | None) -> F.Column:
    """Prediction of one arm from ``pred_greedy`` or ``p_yes``; fails on a missing score or threshold."""
    if mode == "greedy":
        return F.col("pred_greedy").cast("int")
    return reaches("p_yes", 0.5 if threshold is None else threshold)

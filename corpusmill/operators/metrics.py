"""Scores of binary classifiers: confusion, P/R/F1, ROC-AUC, average precision, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.labels import parse_answer
from corpusmill.functions.numbers import ratio
from corpusmill.functions.text import strip
from corpusmill.operators.datasets import positive_prior
from corpusmill.plans.materialize import small_lookup
from corpusmill.plans.prefix import running_totals

RUN_KEYS = ("run", "task")
COUNTS = ("tn", "fp", "fn", "tp")


def confusion(df: DataFrame, by: Sequence[str] = RUN_KEYS, extra: Sequence[Column] = ()) -> DataFrame:
    """Counts of the four outcomes per group, from ``y_true`` and ``y_pred``."""

    def outcome(true: int, pred: int) -> Column:
        return F.count_if((F.col("y_true") == true) & (F.col("y_pred") == pred))

    return df.groupBy(*by).agg(
        outcome(0, 0).alias("tn"),
        outcome(0, 1).alias("fp"),
        outcome(1, 0).alias("fn"),
        outcome(1, 1).alias("tp"),
        *extra,
    )


def confusion_metrics(df: DataFrame) -> DataFrame:
    """Add all threshold metrics to a table with ``tn fp fn tp``; zero division gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    pos, neg, n = tp + fn, tn + fp, tn + fp + fn + tp
    p1, r1, f1 = ratio(tp, tp + fp), ratio(tp, pos), ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = ratio(tn, tn + fn), ratio(tn, neg), ratio(2 * tn, 2 * tn + fp + fn)

    def weighted(zero: Column, one: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).otherwise((zero * neg + one * pos) / n)

    return df.select(
        "*",
        n.alias("n"),
        (tp + fp).alias("n_pred_pos"),
        ratio(tp + tn, n).alias("accuracy"),
        p0.alias("precision_neg"),
        r0.alias("recall_neg"),
        f0.alias("f1_neg"),
        neg.alias("support_neg"),
        p1.alias("precision_pos"),
        r1.alias("recall_pos"),
        f1.alias("f1_pos"),
        pos.alias("support_pos"),
        ((p0 + p1) / 2).alias("macro_precision"),
        ((r0 + r1) / 2).alias("macro_recall"),
        ((f0 + f1) / 2).alias("macro_f1"),
        weighted(p0, p1).alias("weighted_precision"),
        weighted(r0, r1).alias("weighted_recall"),
        weighted(f0, f1).alias("weighted_f1"),
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str] = RUN_KEYS, unparsed: str | None = None
) -> DataFrame:
    """Confusion and all threshold metrics per group; ``unparsed`` names a flag to count."""
    extra = [F.count_if(F.col(unparsed)).alias("n_unparsed")] if unparsed else []
    return confusion_metrics(confusion(df, by, extra))


def complete_runs(df: DataFrame, by: Sequence[str] = RUN_KEYS, score: str = "p_yes") -> DataFrame:
    """Groups in which every row has a score."""
    scored = df.groupBy(*by).agg((F.count("*") == F.count(score)).alias("_scored")).where("_scored")
    return df.join(small_lookup(scored.drop("_scored")), list(by), "left_semi")


def score_histogram(df: DataFrame, by: Sequence[str] = RUN_KEYS, score: str = "p_yes") -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, score).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )


def rank_metrics(df: DataFrame, by: Sequence[str] = RUN_KEYS, score: str = "p_yes") -> DataFrame:
    """ROC-AUC with half credit for ties, and average precision as a step sum.

    Both are NULL for groups with one class or with a missing score. Running totals go
    over distinct scores in slices, so one large run is spread over all tasks.
    """
    ranked = running_totals(score_histogram(df, by, score), by, [F.desc_nulls_last(score)], ["pos", "neg"])
    scored = F.col(score).isNotNull()
    tp = F.col("pos_before") + F.col("pos")
    predicted = tp + F.col("neg_before") + F.col("neg")
    won = F.col("neg").cast("decimal(18,0)") * (2 * F.col("pos_before") + F.col("pos")).cast("decimal(19,0)")
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(scored, F.col("pos"))), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.when(scored, F.col("neg"))), F.lit(0)).alias("n_neg"),
        F.count_if(~scored).alias("_missing"),
        F.sum(F.when(scored, won.cast("decimal(38,0)"))).alias("_won"),
        F.sum(F.when(scored & (predicted > 0), F.col("pos") * (tp / predicted))).alias("_steps"),
    )
    pairs = 2.0 * F.col("n_pos") * F.col("n_neg")
    defined = (F.col("_missing") == 0) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(defined, F.col("_won").cast("double") / pairs).alias("roc_auc"),
        F.when(defined, F.col("_steps") / F.col("n_pos")).alias("pr_auc"),
    )


def with_prior(preds: DataFrame, train: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Predictions with the positive share of their task's train rows."""
    return preds.join(small_lookup(positive_prior(train, keys)), list(keys), "left")


def decide(
    df: DataFrame, mode: str = "greedy", threshold: float | str | None = None, score: str = "p_yes"
) -> DataFrame:
    """Add ``y_pred``: the parsed answer (``greedy``) or ``score >= threshold`` (``prob``).

    Unparsable answers count as negative and are marked. ``threshold`` may name a column.
    """
    if mode not in ("greedy", "prob"):
        raise ValueError(f"mode must be 'greedy' or 'prob', not {mode!r}")
    if mode == "prob" and score not in df.columns:
        raise ValueError(f"mode 'prob' needs the scores in {score!r}")
    out = df
    if "raw_output" in df.columns:
        parsed = parse_answer("raw_output")
        out = out.withColumn("_parsed", parsed).withColumns(
            {
                "pred_greedy": F.coalesce("_parsed", F.lit(0)),
                "unparsed": F.col("_parsed").isNull(),
                "raw_output": strip("raw_output"),
            }
        ).drop("_parsed")
    if mode == "greedy":
        return out.withColumn("y_pred", F.col("pred_greedy"))
    return out.withColumn("y_pred", reaches(score, 0.5 if threshold is None else threshold))


def reaches(score: str, threshold: float | str) -> Column:
    """1 where the score reaches the threshold, a number or a column; fails where either is NULL."""
    value, limit = F.col(score), known_limit(threshold)
    missing = F.raise_error(F.lit("a row without a score cannot be decided by a threshold")).cast("int")
    return F.when(value.isNull(), missing).otherwise((value >= limit).cast("int"))


def known_limit(threshold: float | str) -> Column:
    """The threshold as a column that fails where it is NULL, as for a task without train rows."""
    if not isinstance(threshold, str):
        return F.lit(float(threshold))
    missing = F.raise_error(F.lit(f"no threshold in column {threshold!r}")).cast("double")
    return F.coalesce(F.col(threshold), missing)


def sweep_thresholds() -> list[tuple[str, float]]:
    """The named thresholds 0.05, 0.10, …, 0.95."""
    return [(f"{i / 100:.2f}", i / 100) for i in range(5, 100, 5)]


def threshold_sweep(
    preds: DataFrame,
    thresholds: Sequence[tuple[str, float | str]],
    by: Sequence[str] = RUN_KEYS,
    score: str = "p_yes",
) -> DataFrame:
    """Confusion and metrics of each run at each threshold; runs with a missing score are skipped.

    A threshold is a number or the name of a column that is constant per group (the
    prior). Rows are never multiplied by thresholds: each row counts how many thresholds
    its score reaches, and the counts of a group are summed from the top.
    """
    columns = list(dict.fromkeys(t for _, t in thresholds if isinstance(t, str)))
    levels = F.sort_array(
        F.array(
            *[
                F.struct(known_limit(t).alias("threshold"), F.lit(i).alias("position"), F.lit(name).alias("threshold_name"))
                for i, (name, t) in enumerate(thresholds)
            ]
        )
    )
    # A score reaches the lowest of the sorted thresholds, so their number says which.
    reached = sum((F.coalesce(F.col(score) >= known_limit(t), F.lit(False)).cast("int") for _, t in thresholds), F.lit(0))
    per_level = (
        score_histogram(preds, [*by, *columns], score)
        .groupBy(*by, *columns, reached.alias("_reached"))
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.count_if(F.col(score).isNull()).alias("_missing"),
        )
    )
    # One entry per number of reached thresholds: at most len(thresholds) + 1 per group.
    groups = (
        per_level.groupBy(*by, *columns)
        .agg(
            F.collect_list(F.struct("_reached", "pos", "neg")).alias("_counts"),
            F.sum("pos").alias("_pos"),
            F.sum("neg").alias("_neg"),
            F.sum("_missing").alias("_missing"),
        )
        .where("_missing = 0")
    )
    exploded = groups.select(*by, "_counts", "_pos", "_neg", F.posexplode(levels).alias("_rank", "_level"))

    def above(name: str) -> Column:
        reaching = F.filter("_counts", lambda c: c["_reached"] > F.col("_rank"))
        return F.aggregate(reaching, F.lit(0).cast("bigint"), lambda total, c: total + c[name])

    counted = exploded.withColumns({"tp": above("pos"), "fp": above("neg")}).select(
        *by,
        "_level.threshold_name",
        "_level.threshold",
        (F.col("_neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("_pos") - F.col("tp")).alias("fn"),
        "tp",
    )
    return confusion_metrics(counted)

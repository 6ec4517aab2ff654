"""Queries on predictions: decisions, metrics, sweeps, comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.datasets import document_splits, split_sql, train_labels
from corpusmill.catalog.views import with_views
from corpusmill.functions.numbers import pair_softmax, python_round
from corpusmill.functions.text import SPACE_CLASS
from corpusmill.operators import datasets, guards, metrics, models, reports
from corpusmill.plans.materialize import materialize

THRESHOLDS = [("0.5", 0.5), ("prior", "prior"), *metrics.sweep_thresholds()]
ARMS = {"greedy": ("greedy", None), "half": ("prob", 0.5), "prior": ("prob", "prior")}


def _scored(spark, d):
    return v.predictions(spark, d).where("p_yes is not null")


def _decided(spark, d):
    """Complete runs decided at 0.5."""
    return metrics.decide(metrics.complete_runs(v.answered(spark, d)), "prob", 0.5)


def _rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


MEASURES = [
    "accuracy",
    *[f"{m}_{s}" for s in ("neg", "pos") for m in ("precision", "recall", "f1")],
    *[f"{s}_{m}" for s in ("macro", "weighted") for m in ("precision", "recall", "f1")],
]


def classification(spark, d):
    decided = metrics.decide(v.answered(spark, d), "greedy")
    return _rounded(metrics.classification_metrics(decided, unparsed="unparsed"), MEASURES)


def ranks(spark, d):
    return _rounded(metrics.rank_metrics(v.predictions(spark, d)), ["roc_auc", "pr_auc"])


def sweep(spark, d):
    preds = metrics.with_prior(v.predictions(spark, d), train_labels(spark, d))
    rows = metrics.threshold_sweep(preds, THRESHOLDS)
    rounded = {c: python_round(c, 4) for c in ("threshold", "accuracy", "macro_f1", "precision_pos", "recall_pos", "f1_pos")}
    return rows.withColumns(rounded).select(
        "run", "task", "threshold_name", *rounded, "tn", "fp", "fn", "tp", "n", "n_pred_pos"
    )


def prior(spark, d):
    preds = metrics.with_prior(metrics.complete_runs(v.predictions(spark, d)), train_labels(spark, d))
    decided = metrics.decide(preds, "prob", "prior")
    return decided.groupBy("run", "task").agg(
        F.round(F.max("prior"), 9).alias("prior"), F.sum("y_pred").alias("n_pred_pos")
    )


def decisions(spark, d):
    greedy = metrics.decide(v.answered(spark, d), "greedy").select(
        "run", "task", "file_id", F.col("y_pred").alias("greedy"), "unparsed", "raw_output"
    )
    prob = metrics.decide(_scored(spark, d), "prob", 0.5).select(
        "run", "task", "file_id", F.col("y_pred").alias("prob")
    )
    return greedy.join(prob, ["run", "task", "file_id"], "left")


def softmax(spark, d):
    items = v.table(spark, d, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax",
        F.round(pair_softmax(F.col("l_discount") * 10, F.col("l_tax") * 10), 9).alias("p_yes"),
    )


def _summary(spark, d):
    """Metrics of every complete run; the run stands for the condition."""
    return reports.metrics_rows(_decided(spark, d))


def compared(spark, d):
    rows = materialize(_summary(spark, d))
    keep = ["task", *reports.TABLE_METRICS]
    base, tuned = rows.where("run = 'run0'").select(*keep), rows.where("run = 'run1'").select(*keep)
    return reports.compare_runs(base, tuned, keys=["task"])


def violations(spark, d):
    """Runs of all answers and one that is absent; some lines stand twice, one task has none."""
    rows = metrics.confusion(metrics.decide(v.answered(spark, d), "greedy")).withColumnRenamed("run", "model")
    doubled = rows.unionByName(rows.where("tp > fp"))
    return guards.summary_violations(doubled, ["quality", "toxic", "unseen"], [("run0",), ("run1",), ("run9",)])


def scored_batches(spark, d):
    def make():
        return lambda texts: [(len(t) * 31 % 1009) / 1009 for t in texts]

    docs = v.documents(spark, d).select("doc_id", "text")
    return models.batch_score(docs, make).select("doc_id", F.round("p_yes", 9).alias("p_yes"))


def retried(spark, d):
    """A transform that keeps a third of the text at first, half on retry, then all of it."""

    def make():
        return lambda texts, attempt: [
            t if len(t) % 3 < attempt + 1 else t[: len(t) // (3 - attempt)] for t in texts
        ]

    docs = v.documents(spark, d).select(F.col("doc_id").alias("file_id"), F.col("text").alias("src"))
    plain = v.QualityRules(refusal_phrases=("\\x{0}",), loop_limit=1.0, residue_limit=1.0)
    done = models.transform_with_retry(docs, make, 2, plain)
    return done.select("file_id", "attempt", F.length("out").alias("out_length"), F.array_join("flags", ",").alias("flags"))


def baseline(spark, d):
    """Naive Bayes with balanced class weights, fitted on the train split of all labels at once."""
    splits = materialize(document_splits(spark, d))
    docs = v.documents(spark, d).select(F.col("doc_id").alias("file_id"), "text")
    counts = materialize(models.word_counts(docs.join(splits.select("file_id").distinct(), "file_id", "left_semi")))
    weights = datasets.class_weights(splits.where("split = 'train'"))
    scored = models.word_baseline(counts, splits, weights)
    preds = scored.select(
        F.lit("words").alias("run"), "task", "file_id", F.col("label").alias("y_true"), F.round("p_yes", 6).alias("p_yes")
    )
    return reports.metrics_rows(metrics.decide(materialize(preds), "prob", 0.5))


QUERIES = {
    "pair_softmax": softmax,
    "decision_rule": decisions,
    "prior_threshold": prior,
    "classification_metrics": classification,
    "rank_metrics": ranks,
    "threshold_sweep": sweep,
    "metrics_rows": _summary,
    "compare_runs": compared,
    "results_table": lambda s, d: reports.results_table(_summary(s, d), ["run0", "run1"], keys=["task"], condition="run"),
    "decision_arms": lambda s, d: reports.decision_arms(
        metrics.complete_runs(v.answered(s, d)), train_labels(s, d), ARMS
    ),
    "summary_violations": violations,
    "batch_score": scored_batches,
    "retry_rounds": retried,
    "baseline_classifier": baseline,
}


def _counts(by: str, source: str, pred: str, extra: str = "") -> str:
    return f"""SELECT {by}, count(*) FILTER (y_true = 0 AND {pred} = 0) AS tn, count(*) FILTER (y_true = 0 AND {pred} = 1) AS fp,
        count(*) FILTER (y_true = 1 AND {pred} = 0) AS fn, count(*) FILTER (y_true = 1 AND {pred} = 1) AS tp {extra}
        FROM {source} GROUP BY {by}"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


_MEASURED = f"""SELECT *, tn + fp AS support_neg, tp + fn AS support_pos, tn + fp + fn + tp AS n, tp + fp AS n_pred_pos,
    {_div('tp + tn', '(tn + fp + fn + tp)')} AS accuracy,
    {_div('tn', '(tn + fn)')} AS precision_neg, {_div('tn', '(tn + fp)')} AS recall_neg, {_div('2 * tn', '(2 * tn + fp + fn)')} AS f1_neg,
    {_div('tp', '(tp + fp)')} AS precision_pos, {_div('tp', '(tp + fn)')} AS recall_pos, {_div('2 * tp', '(2 * tp + fp + fn)')} AS f1_pos
    FROM counts"""
_ALL = """SELECT *, (precision_neg + precision_pos) / 2 AS macro_precision, (recall_neg + recall_pos) / 2 AS macro_recall,
    (f1_neg + f1_pos) / 2 AS macro_f1,
    (precision_neg * support_neg + precision_pos * support_pos) / n AS weighted_precision,
    (recall_neg * support_neg + recall_pos * support_pos) / n AS weighted_recall,
    (f1_neg * support_neg + f1_pos * support_pos) / n AS weighted_f1 FROM measured"""
_RANKED = """SELECT run, task, sum(pos) AS p, sum(neg) AS q, sum(neg * (2 * before + pos)) AS won, sum(pos * ((before + pos) / upto::DOUBLE)) AS steps
    FROM (SELECT *, coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(pos + neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM (SELECT run, task, p_yes, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
            FROM preds WHERE p_yes IS NOT NULL GROUP BY ALL)
        WINDOW w AS (PARTITION BY run, task ORDER BY p_yes DESC)) GROUP BY run, task"""
_RANKS = """SELECT r.run, r.task, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg,
    CASE WHEN m.missing = 0 AND p > 0 AND q > 0 THEN won::DOUBLE / (2.0::DOUBLE * p::DOUBLE * q::DOUBLE) END AS roc_auc,
    CASE WHEN m.missing = 0 AND p > 0 AND q > 0 THEN steps / p::DOUBLE END AS pr_auc
    FROM ranked r JOIN (SELECT run, task, count(*) FILTER (p_yes IS NULL) AS missing FROM preds GROUP BY ALL) m
    ON r.run = m.run AND r.task = m.task"""
_PRIOR = "SELECT task, avg(label) AS prior FROM splits WHERE split = 'train' GROUP BY task"
_COMPLETE = """SELECT * FROM answered WHERE (run, task) IN
    (SELECT (run, task) FROM answered GROUP BY run, task HAVING count(*) = count(p_yes))"""


def _fixed(column: str, digits: int = 4, name: str = "") -> str:
    return f"CAST(format('{{:.{digits}f}}', {column}) AS DOUBLE) AS {name or column}"


_SUMMARY = f"""SELECT a.run, a.task, n, {', '.join(_fixed(c) for c in reports.METRIC_COLUMNS if c not in ('roc_auc', 'pr_auc'))},
    {_fixed('roc_auc')}, {_fixed('pr_auc')}, support_pos, support_neg, tn, fp, fn, tp, n_unparsed
    FROM alls a JOIN ranks r ON a.run = r.run AND a.task = r.task"""
_SUMMARY_VIEWS = {
    "complete": _COMPLETE,
    "counts": _counts("run, task", "complete", "CAST(p_yes >= 0.5 AS INTEGER)", ", count(*) FILTER (parsed IS NULL) AS n_unparsed"),
    "measured": _MEASURED,
    "alls": _ALL,
    "ranked": _RANKED,
    "ranks": _RANKS,
    "summary": _SUMMARY,
}
_SPLITS = split_sql("long_labels")


def _arm(name: str, pred: str) -> dict[str, str]:
    return {
        f"{name}_counts": _counts("run, task", "scored", pred),
        f"{name}_measured": _MEASURED.replace("FROM counts", f"FROM {name}_counts"),
        name: _ALL.replace("FROM measured", f"FROM {name}_measured"),
    }


ORACLES = {
    "pair_softmax": """SELECT l_orderkey, l_linenumber, l_discount, l_tax,
        round(1.0::DOUBLE / (1.0::DOUBLE + exp(l_discount * 10 - l_tax * 10)), 9) AS p_yes FROM lineitem""",
    "decision_rule": with_views(
        """SELECT run, task, file_id, coalesce(parsed, 0) AS greedy, parsed IS NULL AS unparsed, trim(raw_output) AS raw_output,
            CAST(p_yes >= 0.5 AS INTEGER) AS prob FROM answered""",
        "answered",
    ),
    "prior_threshold": with_views(
        """SELECT run, p.task, round(max(prior), 9) AS prior, CAST(sum(CAST(p_yes >= prior AS INTEGER)) AS BIGINT) AS n_pred_pos
        FROM complete p JOIN priors q ON p.task = q.task GROUP BY run, p.task""",
        "answered",
        complete=_COMPLETE,
        splits=_SPLITS,
        priors=_PRIOR,
    ),
    "classification_metrics": with_views(
        f"""SELECT run, task, tn, fp, fn, tp, n_unparsed, n, n_pred_pos, support_neg, support_pos,
            {', '.join(f'round({c}, 9) AS {c}' for c in MEASURES)} FROM alls""",
        "answered",
        counts=_counts("run, task", "answered", "coalesce(parsed, 0)", ", count(*) FILTER (parsed IS NULL) AS n_unparsed"),
        measured=_MEASURED,
        alls=_ALL,
    ),
    "rank_metrics": with_views(
        "SELECT run, task, n_pos, n_neg, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ranks",
        "preds",
        ranked=_RANKED,
        ranks=_RANKS,
    ),
    "threshold_sweep": with_views(
        f"""SELECT run, task, threshold_name, {', '.join(_fixed(c) for c in ('threshold', 'accuracy', 'macro_f1', 'precision_pos', 'recall_pos', 'f1_pos'))},
            tn, fp, fn, tp, n, n_pred_pos FROM alls""",
        "answered",
        splits=_SPLITS,
        priors=_PRIOR,
        complete=_COMPLETE,
        limits="""SELECT task, unnest(list_concat([{'n': '0.5', 't': 0.5::DOUBLE}, {'n': 'prior', 't': prior}],
            list_transform(range(5, 100, 5), lambda i: {'n': format('{:.2f}', i / 100.0::DOUBLE), 't': i / 100.0::DOUBLE}))) AS l FROM priors""",
        limited="SELECT c.*, l.n AS threshold_name, l.t AS threshold FROM complete c JOIN limits ON c.task = limits.task",
        counts=_counts("run, task, threshold_name, threshold", "limited", "CAST(p_yes >= threshold AS INTEGER)"),
        measured=_MEASURED,
        alls=_ALL,
    ),
    "metrics_rows": with_views("SELECT * FROM summary", "answered", **_SUMMARY_VIEWS),
    "compare_runs": with_views(
        f"""SELECT a.task, {', '.join(f'a.{m} AS base_{m}, b.{m} AS tuned_{m}, coalesce(b.{m} > a.{m}, false) AS better_{m}' for m in reports.TABLE_METRICS)}
        FROM summary a JOIN summary b ON a.task = b.task AND a.run = 'run0' AND b.run = 'run1'""",
        "answered",
        **_SUMMARY_VIEWS,
    ),
    "results_table": with_views(
        f"""SELECT a.task, CAST(round_even(100.0::DOUBLE * b.support_pos / (b.support_pos + b.support_neg), 0) AS INTEGER) AS prevalence,
            {', '.join(f"{_fixed(f'a.{m} * 100', 2, f'run0_{m}')}, {_fixed(f'b.{m} * 100', 2, f'run1_{m}')}, coalesce(b.{m} > a.{m}, false) AS better_{m}" for m in reports.TABLE_METRICS)}
        FROM summary a JOIN summary b ON a.task = b.task AND a.run = 'run0' AND b.run = 'run1'""",
        "answered",
        **_SUMMARY_VIEWS,
    ),
    "decision_arms": with_views(
        f"""SELECT g.run, g.task, {', '.join(_fixed(f'{t}.{m}', 4, f'{arm}_{m}') for arm, t in (('greedy', 'g'), ('half', 'h'), ('prior', 'p')) for m in ('macro_f1', 'recall_pos', 'accuracy'))}
        FROM greedy_arm g JOIN half_arm h ON g.run = h.run AND g.task = h.task JOIN prior_arm p ON g.run = p.run AND g.task = p.task""",
        "answered",
        splits=_SPLITS,
        priors=_PRIOR,
        complete=_COMPLETE,
        scored="SELECT a.*, prior FROM complete a JOIN priors q ON a.task = q.task",
        **_arm("greedy_arm", "coalesce(parsed, 0)"),
        **_arm("half_arm", "CAST(p_yes >= 0.5 AS INTEGER)"),
        **_arm("prior_arm", "CAST(p_yes >= prior AS INTEGER)"),
    ),
    "summary_violations": with_views(
        """SELECT run AS model, task, 'duplicate' AS problem FROM counts WHERE tp > fp
        UNION ALL SELECT DISTINCT run, 'unseen', 'missing' FROM counts
        UNION ALL SELECT 'run9', unnest(['quality', 'toxic', 'unseen']), 'missing'""",
        "answered",
        counts=_counts("run, task", "answered", "coalesce(parsed, 0)"),
    ),
    "baseline_classifier": with_views(
        _SUMMARY.replace(", n_unparsed", ""),
        "long_labels",
        splits=_SPLITS,
        tf=f"""SELECT file_id, word, count(*) AS n FROM (SELECT doc_id AS file_id,
            unnest(list_filter(regexp_split_to_array(lower(text), '[{SPACE_CLASS}]+'), lambda w: w <> '')) AS word
            FROM documents WHERE doc_id IN (SELECT file_id FROM splits)) GROUP BY ALL""",
        weights="""SELECT task, (greatest(q, 1) + greatest(p, 1)) / (2.0::DOUBLE * greatest(q, 1)) AS w0,
            (greatest(q, 1) + greatest(p, 1)) / (2.0::DOUBLE * greatest(p, 1)) AS w1
            FROM (SELECT task, count(*) FILTER (label = 0) AS q, count(*) FILTER (label = 1) AS p
                FROM splits WHERE split = 'train' GROUP BY task)""",
        seen="""SELECT task, word, coalesce(sum(n) FILTER (label = 0), 0)::DOUBLE AS n0, coalesce(sum(n) FILTER (label = 1), 0)::DOUBLE AS n1
            FROM splits JOIN tf USING (file_id) WHERE split = 'train' GROUP BY ALL""",
        odds="""SELECT task, word, ln((n1 * w1 + 1) / (t1 * w1 + k)) - ln((n0 * w0 + 1) / (t0 * w0 + k)) AS log_odds
            FROM seen JOIN (SELECT task, sum(n0) AS t0, sum(n1) AS t1, count(*)::DOUBLE AS k FROM seen GROUP BY task) USING (task)
            JOIN weights USING (task)""",
        preds="""SELECT 'words' AS run, task, file_id, label AS y_true,
            round(1.0::DOUBLE / (1.0::DOUBLE + exp(-coalesce(m, 0.0::DOUBLE))), 6) AS p_yes
            FROM (SELECT * FROM splits WHERE split = 'test') LEFT JOIN (SELECT task, file_id, sum(n * log_odds) / sum(n)::DOUBLE AS m
                FROM splits JOIN tf USING (file_id) JOIN odds USING (task, word) WHERE split = 'test' GROUP BY ALL) USING (task, file_id)""",
        counts=_counts("run, task", "preds", "CAST(p_yes >= 0.5 AS INTEGER)"),
        measured=_MEASURED,
        alls=_ALL,
        ranked=_RANKED,
        ranks=_RANKS,
    ),
    "batch_score": "SELECT doc_id, round((length(text) * 31 % 1009) / 1009.0::DOUBLE, 9) AS p_yes FROM documents",
    "retry_rounds": """SELECT file_id, attempt, CAST(kept AS INTEGER) AS out_length,
            CASE WHEN kept = 0 THEN 'empty' WHEN kept / greatest(n, 1)::DOUBLE < 0.55 THEN 'too_short' ELSE '' END AS flags
        FROM (SELECT doc_id AS file_id, length(text) AS n, CAST(length(text) % 3 AS INTEGER) AS attempt, length(text) AS kept FROM documents)""",
}

"""Queries that train classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.datasets import document_splits
from corpusmill.catalog.metrics import _ALL, _MEASURED, _RANKED, _RANKS, _SPLITS, _SUMMARY, _counts
from corpusmill.catalog.views import with_views
from corpusmill.functions.text import SPACE_CLASS
from corpusmill.operators import datasets, linear, metrics, models, reports
from corpusmill.plans.materialize import materialize

SETTINGS = linear.LinearSettings(steps=8)


def _fitted(spark, d):
    splits = materialize(document_splits(spark, d))
    docs = v.documents(spark, d).select(F.col("doc_id").alias("file_id"), "text")
    counts = materialize(models.word_counts(docs.join(splits.select("file_id").distinct(), "file_id", "left_semi")))
    weights = datasets.class_weights(splits.where("split = 'train'"))
    return splits, counts, linear.fit_linear(counts, splits, weights, SETTINGS)


def linear_weights(spark, d):
    """Weights of the best step of both tasks, chosen by F1 of the positives on held-out rows."""
    _, _, fit = _fitted(spark, d)
    return fit.weights.select("task", "word", "step", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


def linear_history(spark, d):
    """Held-out counts after every step."""
    _, _, fit = _fitted(spark, d)
    return fit.history.withColumn("f1_pos", F.round("f1_pos", 9))


def linear_classifier(spark, d):
    """Metrics of the fitted classifiers on held-out rows."""
    splits, counts, fit = _fitted(spark, d)
    test = splits.where("split = 'test'").select("task", "file_id", "label")
    preds = linear.linear_scores(test, counts, fit.weights).select(
        F.lit("linear").alias("run"), "task", "file_id", F.col("label").alias("y_true"), F.round("p_yes", 6).alias("p_yes")
    )
    return reports.metrics_rows(metrics.decide(materialize(preds), "prob", 0.5))


QUERIES = {
    "linear_weights": linear_weights,
    "linear_history": linear_history,
    "linear_classifier": linear_classifier,
}

_D = "::DOUBLE"
_FEATURES = {
    "splits": _SPLITS,
    "tf": f"""SELECT file_id, word, count(*) AS n FROM (SELECT doc_id AS file_id,
        unnest(list_filter(regexp_split_to_array(lower(text), '[{SPACE_CLASS}]+'), lambda w: w <> '')) AS word
        FROM documents WHERE doc_id IN (SELECT file_id FROM splits)) GROUP BY ALL""",
    "shares": f"""SELECT task, q, p, (greatest(q, 1) + greatest(p, 1)) / (2.0{_D} * greatest(q, 1)) AS w0,
        (greatest(q, 1) + greatest(p, 1)) / (2.0{_D} * greatest(p, 1)) AS w1
        FROM (SELECT task, count(*) FILTER (label = 0) AS q, count(*) FILTER (label = 1) AS p
            FROM splits WHERE split = 'train' GROUP BY task)""",
    "shared": """SELECT s.task, file_id, label,
        CASE WHEN split = 'train' THEN CASE label WHEN 1 THEN w1 ELSE w0 END / (q * w0 + p * w1) END AS share
        FROM splits s JOIN shares h ON s.task = h.task""",
    "voc": f"""SELECT task, word, ln((any_value(files) + 1.0{_D}) / (count(*) + 1.0{_D})) + 1.0{_D} AS idf
        FROM splits JOIN tf USING (file_id) JOIN (SELECT task, count(*) AS files FROM splits WHERE split = 'train' GROUP BY task) USING (task)
        WHERE split = 'train' GROUP BY task, word HAVING count(*) >= {SETTINGS.min_files}""",
    "raws": "SELECT task, file_id, label, share, word, n * idf AS raw FROM shared JOIN tf USING (file_id) JOIN voc USING (task, word)",
    "feats": f"""SELECT task, file_id, label, share, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY task, file_id)) AS x FROM raws
        UNION ALL SELECT task, file_id, label, share, '', 1.0{_D} FROM shared""",
    "state0": f"""SELECT task, word, idf, 0.0{_D} AS weight, 0.0{_D} AS ahead FROM voc
        UNION ALL SELECT task, '', NULL, 0.0{_D}, 0.0{_D} FROM shares""",
}


def _step(k: int) -> dict[str, str]:
    after = f"ahead - {SETTINGS.rate}{_D} * (g + CASE WHEN s.word = '' THEN 0.0{_D} ELSE {SETTINGS.decay}{_D} END * ahead)"
    push = f"CAST({k - 1} AS DOUBLE) / {k + 2}"

    def cases(label: int, said: str) -> str:
        return f"count(*) FILTER (f.word = '' AND share IS NULL AND label = {label} AND score {said} 0)"

    return {
        f"sums{k}": f"""SELECT f.task, file_id, sum(x * ahead) AS margin, sum(x * weight) AS score
            FROM feats f JOIN state{k - 1} s ON f.task = s.task AND f.word = s.word GROUP BY f.task, file_id""",
        f"grad{k}": f"""SELECT f.task, f.word, coalesce(sum(share * (1.0{_D} / (1.0{_D} + exp(-margin)) - label) * x), 0.0{_D}) AS g,
            {cases(0, '<')} AS tn, {cases(0, '>=')} AS fp, {cases(1, '<')} AS fn, {cases(1, '>=')} AS tp
            FROM feats f JOIN sums{k} s ON f.task = s.task AND f.file_id = s.file_id GROUP BY f.task, f.word""",
        f"state{k}": f"""SELECT s.task, s.word, idf, {after} AS weight, {after} + {push} * ({after} - weight) AS ahead, d.tn, d.fp, d.fn, d.tp
            FROM state{k - 1} s JOIN grad{k} d ON s.task = d.task AND s.word = d.word""",
    }


_STEPS = {name: text for k in range(1, SETTINGS.steps + 2) for name, text in _step(k).items()}
_HISTORY = {
    "history": " UNION ALL ".join(
        f"""SELECT task, {k} AS step, tn, fp, fn, tp,
            CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0{_D} ELSE (2 * tp){_D} / (2 * tp + fp + fn){_D} END AS f1_pos
            FROM state{k + 1} WHERE word = ''"""
        for k in range(1, SETTINGS.steps + 1)
    ),
    "best": "SELECT task, step FROM history QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1_pos DESC, step) = 1",
    "fitted": " UNION ALL ".join(
        f"SELECT task, word, idf, weight, {k} AS step FROM state{k} WHERE task IN (SELECT task FROM best WHERE step = {k})"
        for k in range(1, SETTINGS.steps + 1)
    ),
}

ORACLES = {
    "linear_weights": with_views(
        "SELECT task, word, step, round(idf, 6) AS idf, round(weight, 6) AS weight FROM fitted",
        "long_labels",
        **_FEATURES,
        **_STEPS,
        **_HISTORY,
    ),
    "linear_history": with_views(
        "SELECT task, step, tn, fp, fn, tp, round(f1_pos, 9) AS f1_pos FROM history",
        "long_labels",
        **_FEATURES,
        **_STEPS,
        **_HISTORY,
    ),
    "linear_classifier": with_views(
        _SUMMARY.replace(", n_unparsed", ""),
        "long_labels",
        **_FEATURES,
        **_STEPS,
        **_HISTORY,
        preds=f"""SELECT 'linear' AS run, f.task, f.file_id, label AS y_true,
            round(1.0{_D} / (1.0{_D} + exp(-sum(x * weight))), 6) AS p_yes
            FROM feats f JOIN fitted m ON f.task = m.task AND f.word = m.word WHERE share IS NULL GROUP BY f.task, f.file_id, label""",
        counts=_counts("run, task", "preds", "CAST(p_yes >= 0.5 AS INTEGER)"),
        measured=_MEASURED,
        alls=_ALL,
        ranked=_RANKED,
        ranks=_RANKS,
    ),
}

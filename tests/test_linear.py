"""All tasks fitted by joins, against the same steps in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import datasets, linear
from corpusmill.operators.models import word_counts

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "the", "of"]


def corpus(n=120, seed=5):
    draw = np.random.default_rng(seed)
    texts, splits = [], []
    for i in range(n):
        chosen = list(draw.choice(WORDS, size=draw.integers(1, 9)))
        texts.append((str(i), " ".join(chosen)))
        for task, word in (("a", "alpha"), ("b", "omega")):
            if task == "b" and i % 3 == 0:
                continue
            label = int((word in chosen) != (draw.random() < 0.1))
            splits.append((task, str(i), label, "test" if i % 4 == 0 else "train"))
    texts.append(("empty", ""))
    splits.append(("a", "empty", 0, "test"))
    return texts, splits


def dense_fit(texts, rows, settings):
    """Weights after every step and held-out counts, one task, dense matrices."""
    counts = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
    train = np.array([r == "train" for _, r in rows])
    labels = np.array([label for label, _ in rows], float)
    seen = {w: sum(w in c for c, t in zip(counts, train) if t) for w in WORDS}
    vocabulary = [w for w in WORDS if seen[w] >= settings.min_files]
    idf = {w: np.log((train.sum() + 1) / (seen[w] + 1)) + 1 for w in vocabulary}
    x = np.array([[c.get(w, 0) * idf[w] for w in vocabulary] for c in counts])
    length = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.hstack([np.divide(x, length, out=np.zeros_like(x), where=length > 0), np.ones((len(x), 1))])
    pos, neg = (train & (labels == 1)).sum(), (train & (labels == 0)).sum()
    share = np.where(labels == 1, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg)) / (pos + neg) * train
    decay = np.array([settings.decay] * len(vocabulary) + [0.0])
    w = ahead = np.zeros(x.shape[1])
    steps = []
    for k in range(1, settings.steps + 1):
        gradient = x.T @ (share * (1 / (1 + np.exp(-x @ ahead)) - labels))
        after = ahead - settings.rate * (gradient + decay * ahead)
        ahead = after + (k - 1) / (k + 2) * (after - w)
        w = after
        said = x @ w >= 0
        tp, fp, fn = ((~train & (labels == y) & (said == s)).sum() for y, s in ((1, True), (0, True), (1, False)))
        steps.append((dict(zip([*vocabulary, ""], w)), 2 * tp / max(2 * tp + fp + fn, 1)))
    return steps, x


@pytest.fixture(scope="module")
def fitted(spark):
    texts, splits = corpus()
    settings = linear.LinearSettings(steps=6, min_files=2)
    counts = word_counts(spark.createDataFrame(texts, "file_id string, text string"))
    rows = spark.createDataFrame(splits, "task string, file_id string, label int, split string")
    weights = datasets.class_weights(rows.where("split = 'train'"))
    return texts, splits, settings, counts, rows, linear.fit_linear(counts, rows, weights, settings)


@pytest.mark.parametrize("task", ["a", "b"])
def test_weights_are_those_of_dense_steps(fitted, task):
    texts, splits, settings, counts, rows, fit = fitted
    by_id = dict(texts)
    own = [(by_id[i], (label, split)) for t, i, label, split in splits if t == task]
    steps, x = dense_fit([t for t, _ in own], [r for _, r in own], settings)
    history = {r.step: r.f1_pos for r in fit.history.where(F.col("task") == task).collect()}
    assert history == pytest.approx({k: f1 for k, (_, f1) in enumerate(steps, 1)})
    best = max(range(len(steps)), key=lambda k: (steps[k][1], -k))
    found = fit.weights.where(F.col("task") == task).collect()
    assert {r.step for r in found} == {best + 1}
    assert {r.word: r.weight for r in found} == pytest.approx(steps[best][0], abs=1e-12)
    scored = linear.linear_scores(rows.where(F.col("task") == task), counts, fit.weights).collect()
    weight = np.array([steps[best][0][w] for w in [*[w for w in WORDS if w in steps[best][0]], ""]])
    ids = [i for t, i, _, _ in splits if t == task]
    expected = dict(zip(ids, 1 / (1 + np.exp(-x @ weight))))
    assert {r.file_id: r.p_yes for r in scored} == pytest.approx(expected, abs=1e-12)


def test_a_step_shuffles_partial_sums_only(fitted):
    _, splits, _, counts, rows, fit = fitted
    vocabulary = linear.materialize(linear.word_weights(rows.where("split = 'train'"), counts))
    weights = datasets.class_weights(rows.where("split = 'train'"))
    features, name = linear._bucketed(linear._training_table(rows, counts, vocabulary, weights, "file_id"), "file_id")
    state = fit.weights.select("task", "word", "weight", F.col("weight").alias("ahead"))
    plan = linear._pass(features, linear.materialize(state), "file_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    rows.sparkSession.sql(f"DROP TABLE {name}")


def test_a_task_without_held_out_rows_keeps_its_first_step(spark):
    counts = word_counts(spark.createDataFrame([(str(i), "x y" if i % 2 else "x z") for i in range(8)], "file_id string, text string"))
    rows = spark.createDataFrame([("t", str(i), i % 2, "train") for i in range(8)], "task string, file_id string, label int, split string")
    fit = linear.fit_linear(counts, rows, datasets.class_weights(rows), linear.LinearSettings(steps=3))
    assert {r.step for r in fit.weights.collect()} == {1}
    assert fit.history.count() == 3


def test_weights_too_many_to_broadcast_are_fitted_alike_in_blocks(spark, fitted, monkeypatch):
    _, _, settings, counts, rows, fit = fitted
    monkeypatch.setattr(linear, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(linear, "CHUNK_CELLS", 20)
    passes = []
    monkeypatch.setattr(linear, "_pass", lambda *a: passes.append(a))
    weights = datasets.class_weights(rows.where("split = 'train'"))
    blocks = linear.fit_linear(counts, rows, weights, settings)
    assert not passes
    assert blocks.weights.dtypes == fit.weights.dtypes and blocks.history.dtypes == fit.history.dtypes
    assert sorted(blocks.history.collect()) == sorted(fit.history.collect())

    def found(f):
        return {(r.task, r.word, r.step): (r.idf or 0.0, r.weight) for r in f.weights.collect()}

    ours, theirs = found(blocks), found(fit)
    assert ours.keys() == theirs.keys()
    assert [x for k in sorted(ours) for x in ours[k]] == pytest.approx([x for k in sorted(ours) for x in theirs[k]], abs=1e-12)

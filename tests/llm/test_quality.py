import random
import zlib

import numpy as np

from corpusmill.llm import quality as Q
from corpusmill.llm import queries


def fixture(n=400):
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aou" for c in ("ta", "no", "ru", "re")]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(20, 80)))
        good = draw.random() < 0.7
        rows.append((i, text if good else draw.choice([text.upper() + "!!!", " ".join(text.split()[:2] * 30)])))
        labels.append((i, int(good)))
    return rows, labels


def test_isotonic_steps():
    edges, steps = Q.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 5, 4, 9]), np.array([10.0, 10, 10, 10]))
    assert edges.tolist() == [0, 1, 3] and np.all(np.diff(steps) >= 0)
    edges, steps = Q.isotonic(np.array([]), np.array([]), np.array([]))
    assert steps.tolist() == [0.5]


def test_features_approximate_the_kernel():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(20, 5))
    directions, phases = draw.normal(scale=0.5, size=(5, 20_000)), draw.uniform(0, 2 * np.pi, 20_000)
    z = Q.fourier(x, np.zeros(5), np.ones(5), directions, phases, 10.0)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) * 0.25 / 2)
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows, labels = fixture()
    edges = [(None, None), (9001, ""), (9002, "word " * 100_000), (9003, "\n\n"), (9003, "\n\n")]
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, quality int")
    found = Q.score_documents(make_docs([*rows, *edges], clash=True), marks).collect()
    assert len(found) == len(rows) + len(edges)
    truth = dict(labels)
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 0.05 * len(held)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_normal_equations_equal_one_matrix(spark, make_docs):
    draw = np.random.default_rng(2)
    stats = draw.normal(size=(50, len(Q.STATISTICS)))
    y = draw.integers(0, 2, 50)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, stats)], "_label int, stats array<double>")
    s = Q.QualitySettings(features=20, parts=3)
    k = len(Q.STATISTICS)
    directions, phases = draw.normal(size=(k, 20)), draw.uniform(size=20)
    Q.ship_package(spark)
    left, right = Q._normal_equations(rows, np.zeros(k), np.ones(k), directions, phases, s)
    z = Q.fourier(stats, np.zeros(k), np.ones(k), directions, phases, s.clip)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in Q.score_documents(make_docs([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert Q.score_documents(make_docs([]), none).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries.QUERIES["op4_quality_rff"](spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in found) >= 0.98 * len(found)

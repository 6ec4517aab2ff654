import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing as M
from corpusmill.llm import queries

TARGETS = {"en": 0.3, "fr": 0.5, "junk": 0.2}


def fixture(spark, n=300):
    draw = random.Random(6)
    endings = {"en": ["ing", "ed", "ly"], "fr": ["eux", "ment", "aux"], "junk": ["!!!", "###", "$$$"]}
    rows, labels = [], []
    for i in range(n):
        kind = draw.choice(["en", "en", "en", "fr", "junk"])
        text = " ".join("w" + draw.choice(endings[kind]) for _ in range(draw.randint(10, 60)))
        rows.append((i, text, "en" if kind == "junk" else kind, "s", None))
        labels.append((i, int(kind != "junk")))
    rows += [(None, None, None, None, None), (900, "", "en", None, 1), (901, "wing " * 50_000, "en", None, 1), (5, "again wing", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit("x") for c in ("_id", "copy", "copies", "_text", "_row", "rate", "n_tokens")})
    return docs, spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id bigint, quality int"), rows


def test_totals_meet_targets(spark):
    docs, labels, rows = fixture(spark)
    found = M.mix(docs, labels, TARGETS).collect()
    assert len(found) == len(rows)
    p = np.array([[r[f"p_{d}"] for d in TARGETS] for r in found])
    n, rate = np.array([r.n_tokens for r in found]), np.array([r.rate for r in found])
    assert np.allclose(p.sum(axis=1), 1) and rate.min() >= 0
    assert np.allclose((n * rate) @ p, np.array(list(TARGETS.values())) * n.sum(), atol=2e-4 * n.sum())
    words = {(i, len((t or "").split())) for i, t, *_ in rows}
    assert {(r.doc_id, r.n_tokens) for r in found} == words


def test_rates_equal_projected_gradient_in_memory(spark):
    """Targets that only rates cut off at zero can meet."""
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.6, 0.6], 200)
    n = draw.integers(1, 50, 200)
    shares = spark.createDataFrame([(i, int(k), float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(n, p))], "doc_id bigint, n_tokens bigint, p0 double, p1 double")
    goal = np.array([0.97, 0.03]) * n.sum()
    settings = M.MixSettings(tolerance=1e-6)
    column, totals = M.fit_rates(shares, goal.tolist(), settings)
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    rate = np.ones(200)
    for _ in range(settings.steps):
        residual = goal - (n * rate) @ p
        if np.abs(residual).max() <= 1e-6 * goal.sum():
            break
        rate = np.maximum(0, rate + p @ (inverse @ residual))
    found = np.array([r.rate for r in shares.select("doc_id", column.alias("rate")).orderBy("doc_id").collect()])
    assert np.allclose(found, rate) and (found == 0).any()
    assert np.abs(goal - totals).max() < np.abs(goal - n @ p).max() / 5


def test_resample(spark):
    docs, labels, rows = fixture(spark)
    out = M.resample(docs, labels, TARGETS)
    assert out.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    rates = {r.doc_id: (r.rate, r.copies) for r in M.mix(docs, labels, TARGETS).collect() if r.doc_id != 5}
    for i, (rate, copies) in rates.items():
        assert counted.get(i, 0) == copies and abs(copies - rate) < 1


def test_classifier_knows_the_domains(spark):
    docs, labels, _ = fixture(spark)
    found = M.mix(docs.where("doc_id < 300 and doc_id <> 5"), labels, TARGETS).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in found:
        assert r.p_junk > 0.5 if "#" in r.text else True
        assert r.p_fr > 0.5 if "eux" in r.text else True


def test_edges(spark):
    docs, labels, _ = fixture(spark)
    assert M.mix(docs.limit(0), labels, TARGETS).collect() == []
    assert {round(r.rate, 6) for r in M.mix(docs, labels.limit(0), {"en": 1.0, "fr": 1.0}).collect()} == {1.0}
    with pytest.raises(ValueError):
        M.mix(docs, labels, {"en": -1.0, "fr": 2.0})


def test_query(spark):
    found = queries.QUERIES["op1_soft_mixing"](spark, "/root/testdata/sf0.01")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    sums = found.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")) for d in queries.TARGETS]).first()
    for share, total in zip(queries.TARGETS.values(), sums[1:]):
        assert abs(total / sums[0] - share) < 1e-3

"""Mixing to target weights when a document may belong to several domains.

A naive Bayes classifier, fitted on a labelled table, gives every document posterior
probabilities of the domains. Each document then gets a rate, the number of times it is to
be used: not negative, and such that the expected tokens of each domain (rate x tokens x
posterior, summed) match the targets. The rates solve a least-squares problem by projected
gradient steps. A step needs the totals of the domains only, so an iteration is one
aggregation over narrow rows; each row replays the steps so far from the list of residuals.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WHITE_CLASS, bounded_sample, broadcast_if_small, stage, unused_name, whole_text


@dataclass(frozen=True)
class MixSettings:
    """``max_labelled`` rows and ``max_features`` word endings bound the classifier.

    ``certainty`` is the number of words whose evidence counts in full; longer texts weigh no
    more, since words of one text are not independent.
    """

    max_labelled: int = 20_000
    max_features: int = 4_000
    ending: int = 3
    certainty: float = 30.0
    steps: int = 25
    tolerance: float = 1e-4


def _words(docs: DataFrame, keep: Sequence[str], ending: int) -> DataFrame:
    """The kept columns and the ending of each word; one row with NULL for a text without words."""
    words = F.split(F.trim(F.regexp_replace("_text", f"{WHITE_CLASS}+", " ")), " ")
    return docs.select(*keep, F.explode(words).alias("_word")).select(
        *keep, F.when(F.col("_word") != "", F.right("_word", F.lit(ending))).alias("ending")
    )


@dataclass(frozen=True)
class DomainModel:
    """``features``: ending and an array of log-likelihoods per domain; ``unseen`` for other endings."""

    domains: tuple[str, ...]
    features: DataFrame
    unseen: tuple[float, ...]
    priors: tuple[float, ...]


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: Sequence[str], s: MixSettings, id_col: str = "doc_id", text_col: str = "text"
) -> DomainModel:
    """Counts of word endings per domain in a bounded sample of labelled documents.

    ``labelled`` has ``_id`` and ``_domain``; rows of other domains are left out. A domain without
    rows keeps a smoothed share.
    """
    # At most max_labelled rows, so a broadcast has a bound.
    known = labelled.where(F.col("_domain").isin(*domains))
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(known), "_id")
    ending_counts = _words(rows, ["_domain"], s.ending).where("ending is not null").groupBy("_domain", "ending").agg(F.count("*").alias("n"))
    per = [F.sum(F.when(F.col("_domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    table = ending_counts.groupBy("ending").agg(*per, F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(s.max_features)
    counted = stage(table, "ending_counts").df
    sums = counted.agg(F.count("*"), *[F.sum(f"n{i}") for i in range(len(domains))]).first()
    size, totals = sums[0], [x or 0 for x in sums[1:]]
    likelihood = [F.log((F.col(f"n{i}") + 0.5) / (totals[i] + 0.5 * (size + 1))) for i in range(len(domains))]
    unseen = tuple(math.log(0.5 / (t + 0.5 * (size + 1))) for t in totals)
    found = {r["_domain"]: r["count"] for r in known.groupBy("_domain").count().collect()}
    total = sum(found.values()) + len(domains)
    priors = tuple(math.log((found.get(d, 0) + 1) / total) for d in domains)
    features = counted.select("ending", *[x.alias(f"l{i}") for i, x in enumerate(likelihood)])
    return DomainModel(tuple(domains), features, unseen, priors)


def posteriors(docs: DataFrame, model: DomainModel, s: MixSettings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` (words) and ``p0``, ``p1``, ... in the order of the domains.

    A text without words has the prior. Words are summed per row of the input, in the task
    that reads it, so repeated and NULL IDs keep a line per row.
    """
    k = range(len(model.domains))
    row = F.monotonically_increasing_id().alias("_row")
    rows = docs.select(row, F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    # The features are bounded by max_features.
    scored = _words(rows, ["_row", "doc_id"], s.ending).join(F.broadcast(model.features), "ending", "left")
    seen = F.col("ending").isNotNull()
    terms = [F.when(seen, F.coalesce(F.col(f"l{i}"), F.lit(model.unseen[i]))).otherwise(0.0) for i in k]
    sums = scored.groupBy("_row", "doc_id").agg(
        F.count("ending").alias("n_tokens"), *[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)]
    )
    damped = F.least(F.lit(1.0), F.lit(s.certainty) / F.greatest(F.col("n_tokens"), F.lit(1)))
    logs = sums.select("doc_id", "n_tokens", *[(F.lit(model.priors[i]) + damped * F.col(f"s{i}")).alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k])
    shares = logs.select("doc_id", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k])
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return shares.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def _rate(steps: Sequence[Sequence[float]], k: int) -> Column:
    """Rate of a row after the given steps: from 1, along its posterior, never below 0."""
    if not steps:
        return F.lit(1.0)
    vectors = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in steps])

    def step(rate: Column, v: Column) -> Column:
        return F.greatest(F.lit(0.0), rate + sum((F.get(v, F.lit(i)) * F.col(f"p{i}") for i in range(k)), F.lit(0.0)))

    return F.aggregate(vectors, F.lit(1.0), step)


def fit_rates(shares: DataFrame, targets: Sequence[float], s: MixSettings) -> tuple[Column, list[float]]:
    """Expression of the rate over the columns of ``posteriors``, and the totals it reaches.

    Minimises the squared distance of the domain totals from the targets, whitened by the
    token-weighted second moments of the posteriors: a gradient step is then
    posterior x inverse moments x residual for each row, cut off at 0. Documents of equal
    posterior get equal rates, whatever their length. Steps end at ``tolerance`` (share of all
    tokens) or after ``steps``; a target whose domain no document has stays out of reach.
    """
    k = len(targets)
    goal = np.asarray(targets, float)
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = shares.agg(*[F.sum(n * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()
    moments = np.zeros((k, k))
    for (i, j), x in zip(pairs, found):
        moments[i, j] = moments[j, i] = x or 0.0
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    scale = max(float(goal.sum()), 1.0)
    steps: list[list[float]] = []
    while True:
        rate = _rate(steps, k)
        reached = shares.agg(*[F.sum(n * rate * F.col(f"p{i}")) for i in range(k)]).first()
        totals = np.array([x or 0.0 for x in reached])
        if np.abs(goal - totals).max() <= s.tolerance * scale or len(steps) >= s.steps:
            return rate, totals.tolist()
        steps.append((inverse @ (goal - totals)).tolist())


def copies(rate: Column, key: Column) -> Column:
    """Whole number of copies whose mean is the rate: the fraction is drawn from the key's hash."""
    drawn = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(2**31)) / F.lit(float(2**31))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame, domains: Sequence[str], s: MixSettings, poor: str = "junk") -> DataFrame:
    """``_id`` and ``_domain`` of a bounded sample of labelled documents.

    The domain is ``poor`` for quality 0, else the language. NULL labels or IDs are left out.
    """
    marked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), "quality")
    named = marked.join(docs.select(F.col("doc_id").alias("_id"), "lang"), "_id")
    domain = F.when(F.col("quality") == 0, F.lit(poor)).otherwise(F.col("lang"))
    single = named.groupBy("_id").agg(F.max(domain).alias("_domain")).where(F.col("_domain").isin(*domains))
    return stage(bounded_sample(single, s.max_labelled), "labelled_domains").df


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], s: MixSettings = MixSettings()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    ``targets`` are the wanted shares of tokens; the total stays that of the input. Without
    documents there are no rows; without labels all posteriors are equal and all rates 1.
    """
    domains = list(targets)
    weights = np.array([targets[d] for d in domains], float)
    if weights.min() < 0 or weights.sum() <= 0:
        raise ValueError("target weights must be non-negative and not all 0")
    model = fit_domains(docs, labelled_domains(docs, labels, domains, s), domains, s)
    shares = stage(posteriors(docs, model, s), "posteriors").df
    total = shares.agg(F.sum("n_tokens")).first()[0] or 0
    rate, _ = fit_rates(shares, (weights / weights.sum() * total).tolist(), s)
    rated = shares.select("*", rate.alias("rate"))
    return rated.select(
        "doc_id",
        "n_tokens",
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def resample(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], s: MixSettings = MixSettings()) -> DataFrame:
    """Each document as often as its ``copies`` say, with all its columns.

    Rows that share an ID share the mean of their rates.
    """
    key = F.col("doc_id")
    rates = mix(docs, labels, targets, s).groupBy("doc_id").agg(F.avg("rate").alias("rate"))
    # Only rows that go or come more than once are looked up; the others stay as they are.
    changed = stage(rates.select("doc_id", copies(F.col("rate"), key).alias("copies")).where("copies <> 1"), "copies").df
    joined = docs.join(broadcast_if_small(changed), docs["doc_id"].eqNullSafe(changed["doc_id"]), "left")
    number = unused_name(docs, "copy")
    again = F.explode(F.array_repeat(F.lit(1), F.coalesce(changed["copies"], F.lit(1)))).alias(number)
    return joined.select(*[docs[c] for c in docs.columns], again).drop(number)

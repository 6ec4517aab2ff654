"""Toxic passages as maximal scoring segments of token log-odds.

Training counts, over a bounded sample of labelled documents, in how many toxic and clean
documents each word occurs. Log-odds are smoothed with an informative Dirichlet prior, the
frequency in both classes together, and count only where a likelihood-ratio test is sure of
a difference. A word too rare to judge falls back on its longest prefix that is not, counted
over the words without an entry of their own. A word repeated in a text counts in full once,
then a half, a third and so on.

Scoring runs once over the token scores of a text and finds every maximal segment in linear
time. The E-value of a segment says how many as good a clean text of that length has by
chance; significant segments are passages. Their summed evidence becomes a probability by a
logistic curve fitted on labelled documents that the lexicon has not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import key_remainder, learnable_labels, ship_package, stage, whole_text
from corpusmill.llm.minhash import _odd_numbers, shingle_hashes

TOKEN = re.compile(r"[^\W\d_]+")
COUNTED_UNITS = 100_000
CACHED_WORDS = 150_000
COPY_KEYS = 4
ROWS_AT_A_TIME = 500
# Up to so many entries a filter states them; more are broadcast.
STATED_UNITS = 2_000
END = "$"


@dataclass(frozen=True)
class ToxicitySettings:
    """``max_labelled`` bounds the sample to learn from, ``max_units`` the lexicon."""

    max_labelled: int = 60_000
    max_units: int = 50_000
    prefixes: tuple[int, ...] = (8, 7, 6, 5, 4, 3)
    least_deviance: float = 20.0
    drift: float = 0.1
    prior_share: float = 0.005
    calibration_fifths: int = 1
    bins: int = 200


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    prefixes: tuple[int, ...]
    drift: float
    rate: float  # of the extreme-value law, per unit of score
    scale: float  # expected segments per token at score 0
    slope: float
    offset: float


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class TokenScores:
    """Scores of tokens by lexicon entry: the word itself, else its longest prefix that has one."""

    def __init__(self, lexicon: dict[str, float], prefixes: Sequence[int]):
        self.lexicon, self.prefixes = lexicon, sorted(prefixes, reverse=True)
        self.known: dict[str, float] = {}

    def look_up(self, word: str) -> float:
        score = self.lexicon.get(word + END)
        if score is None:
            score = 0.0
            for n in self.prefixes:
                if len(word) >= n and word[:n] in self.lexicon:
                    score = self.lexicon[word[:n]]
                    break
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[word] = score
        return score

    def of(self, words: Sequence[str]) -> np.ndarray:
        known, look_up = self.known, self.look_up
        scores = np.array([s if (s := known.get(w)) is not None else look_up(w) for w in words], float)
        times: Counter = Counter()
        for i in np.flatnonzero(scores > 0).tolist():
            times[words[i]] += 1
            scores[i] /= times[words[i]]
        return scores


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last + 1, score), in linear time.

    Each candidate remembers the last earlier one that starts lower, so no candidate is
    passed over twice.
    """
    sums = np.cumsum(scores)
    found: list[list] = []  # first, last, sum before, sum after, place of the last one that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, float(sums[i] - scores[i]), float(sums[i])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, i, low, high, j])
                break
            first, low, j, keep = found[j][0], found[j][2], found[j][4], j
            del found[keep:]
    return [(a, b + 1, high - low) for a, b, low, high, _ in found]


def evidence(model: ToxicityModel, n_tokens: int, score: float) -> float:
    """-ln of the E-value of a segment."""
    return model.rate * score - math.log(model.scale * max(n_tokens, 1))


def probability(model: ToxicityModel, total: float) -> float:
    x = model.offset + model.slope * math.log1p(total)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _count_units(docs: DataFrame) -> DataFrame:
    """``word`` and the toxic and clean documents that have it, one row per task and word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(words, pa.string())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts[::-1]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("_label")):
                counts[label.as_py() > 0].update(set(tokens(text.as_py())))
                if len(counts[0]) + len(counts[1]) > COUNTED_UNITS:
                    yield rows()
        yield rows()

    return docs.select("text", "_label").mapInArrow(run, "word string, toxic bigint, clean bigint")


def _log_odds(has: Column, of: float) -> Column:
    return F.log(has / (F.lit(of + 0.5) - has))


def _deviance(a: Column, c: Column, n_toxic: int, n_clean: int) -> Column:
    """Likelihood-ratio statistic of a unit's document counts in the two classes."""
    n = max(n_toxic + n_clean, 1)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    both = a + c
    total = part(a, both * F.lit(n_toxic / n)) + part(c, both * F.lit(n_clean / n))
    rest = F.lit(n) - both
    total += part(F.lit(n_toxic) - a, rest * F.lit(n_toxic / n)) + part(F.lit(n_clean) - c, rest * F.lit(n_clean / n))
    return 2 * total


def fit_lexicon(words: DataFrame, n_toxic: int, n_clean: int, s: ToxicitySettings) -> dict[str, float]:
    """Scores of words and prefixes, at most ``max_units`` of them, the surest first.

    ``words`` has ``word``, ``toxic`` and ``clean``, numbers of documents; ``n_toxic`` and ``n_clean``
    are their sums. Levels go from whole words to short
    prefixes; what a level judges does not count for shorter prefixes.
    """
    spark = words.sparkSession
    n = n_toxic + n_clean
    weight = max(2.0, s.prior_share * n)
    lexicon: dict[str, float] = {}
    rest = words.select(F.concat("word", F.lit(END)).alias("unit"), "toxic", "clean")
    for level in (0, *s.prefixes):
        # Each level groups what the one before left, so the rows become fewer.
        if level:
            bare = F.rtrim(F.col("unit"), F.lit(END))
            rest = rest.groupBy(F.substring(bare, 1, level).alias("unit")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        sums = stage(rest, "units").df
        a, c = F.col("toxic"), F.col("clean")
        prior = F.lit(weight / max(n, 1)) * (a + c)
        odds = _log_odds(a + prior, n_toxic + weight) - _log_odds(c + prior, n_clean + weight)
        error = F.sqrt(1 / (a + prior) + 1 / (c + prior))
        deviance = _deviance(a, c, n_toxic, n_clean)
        judged = (
            sums.where(F.length("unit") >= level)
            .select("unit", odds.alias("odds"), error.alias("error"), deviance.alias("deviance"))
            .where(F.col("deviance") >= s.least_deviance)
            .orderBy(F.desc("deviance"), "unit")
            .limit(max(0, s.max_units - len(lexicon)))
            .collect()
        )
        # The doubtful part of the log-odds does not count.
        found = {r.unit: math.copysign(max(0.0, abs(r.odds) - r.error), r.odds) for r in judged}
        lexicon |= found
        if len(found) > STATED_UNITS:
            mine = F.broadcast(spark.createDataFrame([(u,) for u in found], "unit string"))
            rest = sums.join(mine, "unit", "left_anti")
        else:
            rest = sums.where(~F.col("unit").isin(list(found))) if found else sums
    return lexicon


def _extreme_value_law(histogram: dict[float, int], n_segments: int, drift: float) -> tuple[float, float]:
    """Rate and scale of the law of chance segments, from token scores of clean documents.

    The rate solves sum p(s) exp(rate * s) = 1. One imagined token of the highest score keeps
    it finite where clean texts have no token that speaks against them.
    """
    top = max([1.0, *histogram])
    counts = Counter({s - drift: n for s, n in histogram.items()}) + Counter({top - drift: 1, -drift: 1})
    values, weights = np.array(list(counts)), np.array(list(counts.values()), float)
    weights /= weights.sum()
    low, high = 1e-6, 50.0
    for _ in range(100):
        rate = (low + high) / 2
        if np.sum(weights * np.exp(np.minimum(rate * values, 600))) > 1:
            high = rate
        else:
            low = rate
    least = min([s - drift for s in histogram if s > drift], default=top - drift)
    scale = (n_segments + 0.5) / max(sum(histogram.values()), 1) * math.exp(min(rate * least, 100))
    return rate, scale


def fit_logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve over counted values, with smoothed targets."""
    n1, n0 = positive.sum(), negative.sum()
    weights = positive + negative
    target = (positive * (n1 + 1) / (n1 + 2) + negative / (n0 + 2)) / np.maximum(weights, 1)
    slope, offset = 0.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(offset + slope * x, -30, 30)))
        g = np.array([np.sum(weights * (p - target) * x) + ridge * slope, np.sum(weights * (p - target))])
        v = weights * p * (1 - p)
        h = np.array([[np.sum(v * x * x) + ridge, np.sum(v * x)], [np.sum(v * x), np.sum(v)]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(slope)), float(offset)


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sampled texts without exact and most near copies, which would pass for independent evidence.

    Of texts with the same label that share one of a few MinHash values of word triples, the
    one with the least digest stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _odd_numbers(COPY_KEYS, 31)
        for batch in batches:
            keys = []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py().encode(), 3)
                keys.append([(hashes * f).min().view(np.int64) for f in factors] if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "_keys"])

    once = sample.withColumn("_digest", F.unhex(F.sha2("text", 256))).dropDuplicates(["_digest", "_label"])
    schema = T.StructType([*once.schema.fields, T.StructField("_keys", T.ArrayType(T.LongType()))])
    keyed = stage(once.mapInArrow(run, schema), "labelled").df
    held = keyed.select("_digest", "_label", F.explode("_keys").alias("_key"))
    heads = held.groupBy("_key", "_label").agg(F.min("_digest").alias("_head"))
    alone = held.join(heads, ["_key", "_label"]).groupBy("_digest", "_label").agg(F.min(F.col("_digest") == F.col("_head")).alias("_first"))
    # At most max_labelled digests.
    kept = F.broadcast(stage(alone.where("_first").select("_digest", "_label"), "labelled_kept").df)
    return keyed.join(kept, ["_digest", "_label"], "left_semi").select("text", "_label", "_fold")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, s: ToxicitySettings = ToxicitySettings(), id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from a bounded sample of labelled rows for which ``held_out`` is false.

    Without labelled rows, or with one class only, every text gets the share of that class,
    smoothed.
    """
    ship_package(docs.sparkSession)
    sample = learnable_labels(labels, id_col, label, held_out, s.max_labelled)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(5)) < s.calibration_fifths
    # At most max_labelled rows of two numbers, so a broadcast has a bound.
    joined = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).join(
        F.broadcast(sample), "_id"
    )
    labelled = _without_copies(joined.select("text", "_label", fold.alias("_fold")))
    train = labelled.where("not _fold")
    words = stage(_count_units(train).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    sums = words.df.agg(F.sum("toxic"), F.sum("clean")).first()
    lexicon = fit_lexicon(words.df, sums[0] or 0, sums[1] or 0, s)
    words.release()

    apart = labelled.where("_fold")
    blank = ToxicityModel(lexicon, s.prefixes, s.drift, 1.0, 1.0, 0.0, 0.0)
    seen = _clean_scores(apart.where("_label = 0"), blank)
    rate, scale = _extreme_value_law(*seen, s.drift)
    law = ToxicityModel(lexicon, s.prefixes, s.drift, rate, scale, 0.0, 0.0)
    totals = passages(apart, law, "_label", "text").select("id", F.log1p("evidence").alias("x"))
    width = 10.0 / s.bins
    binned = totals.groupBy("id", F.least(F.floor(F.col("x") / width), F.lit(s.bins - 1)).alias("bin")).count()
    counts = np.zeros((2, s.bins))
    for r in binned.collect():
        counts[int(r["id"] > 0), int(r["bin"])] += r["count"]
    centres = np.where(np.arange(s.bins) == 0, 0.0, (np.arange(s.bins) + 0.5) * width)
    slope, offset = fit_logistic(centres, counts[1], counts[0])
    return ToxicityModel(lexicon, s.prefixes, s.drift, rate, scale, slope, offset)


def _clean_scores(docs: DataFrame, model: ToxicityModel) -> tuple[dict[float, int], int]:
    """Histogram of token scores (to a hundredth) and the number of maximal segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = TokenScores(m.lexicon, m.prefixes)
        seen: Counter = Counter()
        segments = 0
        for batch in batches:
            for text in batch.column("text"):
                scores = scorer.of(tokens(text.as_py()))
                values, counts = np.unique(np.round(scores, 2), return_counts=True)
                seen.update(dict(zip(values.tolist(), counts.tolist())))
                segments += len(maximal_segments(scores - m.drift))
        seen[math.inf] = segments
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["score", "n"])

    rows = docs.select("text").mapInArrow(run, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n"))
    found = {r.score: r.n for r in rows.collect()}
    segments = found.pop(math.inf, 0)
    return found, segments


PASSAGES = "array<struct<start:int,end:int,score:double,e_value:double>>"


def passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, summed ``evidence``, ``score`` from 0 to 1 and the significant ``passages`` of each text.

    Passages are code point ranges with an E-value below 1. Empty and NULL texts have no
    evidence and the score of that. Every row gives a row.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = TokenScores(m.lexicon, m.prefixes)
        for batch in batches:
            totals, found = [], []
            for value in batch.column("text"):
                text = value.as_py()
                words = tokens(text)
                scores = scorer.of(words) - m.drift
                here, total = [], 0.0
                segments = maximal_segments(scores) if len(scores) and scores.max() > 0 else []
                spans = [x.span() for x in TOKEN.finditer(text)] if segments else []
                if len(spans) != len(words):  # lower case can change how a letter is written
                    spans = [(0, len(text))] * len(words)
                for first, last, score in segments:
                    bits = evidence(m, len(words), score)
                    if bits > 0:
                        total += bits
                        here.append({"start": spans[first][0], "end": spans[last - 1][1], "score": score, "e_value": math.exp(-bits)})
                totals.append(total)
                found.append(here)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(totals, pa.float64()),
                    pa.array([probability(m, t) for t in totals], pa.float64()),
                    pa.array(found, arrow),
                ],
                names=["id", "evidence", "score", "passages"],
            )

    return source.mapInArrow(run, f"id {kind}, evidence double, score double, passages {PASSAGES}")


def score_documents(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings(), modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_passages``.

    Labels are learnt only where the key's remainder differs from ``held_out``. A NULL ID has
    no remainder and is not held out.
    """
    model = fit(docs, labels, key_remainder("doc_id", modulus) == held_out, s)
    scored = passages(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(key_remainder("id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings(), threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, with all their columns and without a shuffle of text."""
    model = fit(docs, labels, key_remainder("doc_id", 3) == 1, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = TokenScores(m.lexicon, m.prefixes)
        for batch in (b.slice(i, ROWS_AT_A_TIME) for b in batches for i in range(0, b.num_rows, ROWS_AT_A_TIME)):
            keep = []
            for value in batch.column("text"):
                words = tokens(value.as_py() or "")
                scores = scorer.of(words) - m.drift
                segments = maximal_segments(scores) if len(scores) and scores.max() > 0 else []
                total = sum(max(0.0, evidence(m, len(words), x)) for _, _, x in segments)
                keep.append(probability(m, total) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

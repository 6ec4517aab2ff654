"""Quality scores from document statistics, a Gaussian kernel and isotonic calibration.

Each text is reduced to a dozen statistics. Random Fourier features approximate a Gaussian
kernel over them, so that kernel ridge regression becomes a linear fit whose normal
equations are sums over documents: each partition adds up its own matrix, and the driver
adds the matrices of a fixed number of partitions. A monotone step curve, fitted on labelled
documents apart, turns ridge scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import key_remainder, learnable_labels, ship_package, stage, whole_text

STATISTICS = (
    "log_chars upper symbols exclamations digits stops distinct_words word_growth repeated_lines "
    "immediate_repeats top_word mean_word_length short_words words_per_line other_marks"
).split()
BYTES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "symbols": [ord(c) for c in "#*$%&|<>"],
    "exclamations": [ord("!")],
    "digits": range(0x30, 0x3A),
    "stops": [ord(c) for c in ".,;:?"],
    "other_marks": [ord(c) for c in "@/\\=+_~^{}[]()\"'`-"],
}
_MASKS = np.zeros((len(BYTES), 256))
for _row, _codes in enumerate(BYTES.values()):
    _MASKS[_row, list(_codes)] = 1


@dataclass(frozen=True)
class QualitySettings:
    """``max_labelled`` bounds the sample to learn from; ``parts`` the matrices sent to the driver."""

    max_labelled: int = 40_000
    features: int = 300
    bandwidth: float = 4.0
    ridge: float = 1e-3
    parts: int = 8
    clip: float = 5.0
    bins: int = 400
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # lowest ridge score of each step
    steps: np.ndarray  # probability of each step
    clip: float

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.spread, self.directions, self.phases, self.clip)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        ridge = self.fourier(stats) @ self.weights
        return self.steps[np.maximum(np.searchsorted(self.edges, ridge, side="right") - 1, 0)]


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [math.log1p(len(text)), *[0.0] * (len(STATISTICS) - 1)]
    histogram = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    marks = dict(zip(BYTES, (_MASKS @ histogram).tolist()))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(len(text)),
        marks["upper"] / max(marks["upper"] + marks["lower"], 1),
        math.log1p(marks["symbols"] / n),
        math.log1p(marks["exclamations"] / n),
        math.log1p(marks["digits"] / n),
        math.log1p(marks["stops"] / n),
        len(counts) / n,
        math.log1p(len(counts)) / math.log1p(n),
        1 - len(set(lines)) / len(lines),
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        math.log(sum(map(len, words)) / n),
        sum(len(w) < 3 for w in counts) / len(counts),
        math.log1p(n / len(lines)),
        math.log1p(marks["other_marks"] / n),
    ]


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, directions: np.ndarray, phases: np.ndarray, clip: float) -> np.ndarray:
    """Random Fourier features and a constant."""
    centred = np.clip((stats - mean) / spread, -clip, clip)
    waves = np.cos(centred @ directions + phases) * math.sqrt(2 / len(phases))
    return np.hstack([waves, np.ones((len(stats), 1))])


def isotonic(values: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: lowest value and share of each step, shares not falling.

    Shares are drawn to the overall share with the weight of one document, so no step is
    surer than its size allows.
    """
    overall = (good.sum() + 0.5) / (total.sum() + 1)
    blocks: list[list[float]] = []
    for value, g, n in zip(values, good, total):
        blocks.append([value, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, g1, n1 = blocks.pop()
            blocks[-1][1] += g1
            blocks[-1][2] += n1
    if not blocks:
        return np.array([-np.inf]), np.array([overall])
    edges = np.array([b[0] for b in blocks])
    shares = np.array([(b[1] + overall) / (b[2] + 1) for b in blocks])
    return edges, np.maximum.accumulate(shares)


def _stats_of(docs: DataFrame) -> DataFrame:
    """Statistics of ``_id``, ``text``, ``_label``, ``_fold`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label"), batch.column("_fold"), pa.array(stats, pa.list_(pa.float64()))],
                names=["_label", "_fold", "stats"],
            )

    return docs.select("text", "_label", "_fold").mapInArrow(run, "_label int, _fold boolean, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(train: DataFrame, mean, spread, directions, phases, s: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows; each of ``parts`` partitions sends one matrix."""
    size = s.features + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = fourier(_matrix(batch.column("stats")), mean, spread, directions, phases, s.clip)
                y = batch.column("_label").to_numpy(zero_copy_only=False)
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = train.repartition(s.parts).mapInArrow(run, "sums binary").collect()
    added = np.sum([np.frombuffer(r.sums).reshape(size, size + 1) for r in sums], axis=0)
    return added[:, :size], added[:, size]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, s: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel:
    """Learn from a bounded sample of labelled rows for which ``held_out`` is false.

    Four fifths fit the ridge scores, the rest the calibration. Without labelled rows every
    text scores one half; with one class only, the smoothed share of that class.
    """
    ship_package(docs.sparkSession)
    sample = learnable_labels(labels, id_col, label, held_out, s.max_labelled)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(5)) == 0
    # At most max_labelled rows of two numbers, so a broadcast has a bound.
    joined = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).join(F.broadcast(sample), "_id")
    rows = stage(_stats_of(joined.select("text", "_label", fold.alias("_fold"))), "statistics").df
    train, apart = rows.where("not _fold"), rows.where("_fold")

    k = len(STATISTICS)
    moments = train.agg(
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(k)],
    ).first()
    mean = np.array([x or 0.0 for x in moments[:k]])
    spread = np.array([x or 1.0 for x in moments[k:]])
    random = np.random.default_rng(s.seed)
    directions = random.normal(scale=1 / s.bandwidth, size=(k, s.features))
    phases = random.uniform(0, 2 * math.pi, s.features)
    left, right = _normal_equations(train, mean, spread, directions, phases, s)
    count = max(left[-1, -1], 1.0)
    weights = np.linalg.solve(left + s.ridge * count / s.features * np.eye(len(left)) + 1e-9 * np.eye(len(left)), right)

    blank = QualityModel(mean, spread, directions, phases, weights, np.array([]), np.array([]), s.clip)
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ridge = shared.value.fourier(_matrix(batch.column("stats"))) @ shared.value.weights
                bins = np.floor(np.clip(ridge, -0.5, 1.5) * s.bins).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(bins)], names=["label", "bin"])

    binned = apart.mapInArrow(run, "label int, bin bigint").groupBy("bin").agg(
        F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("good"), F.count("*").alias("n")
    )
    found = sorted((r.bin, r.good, r.n) for r in binned.collect())
    table = np.array(found, float).reshape(-1, 3)
    edges, steps = isotonic(table[:, 0] / s.bins, table[:, 1], table[:, 2])
    return QualityModel(mean, spread, directions, phases, weights, edges, steps, s.clip)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` of each row; NULL and empty texts score by their statistics, all zero."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(shared.value.scores(stats), pa.float64())], names=["id", "score"]
            )

    return source.mapInArrow(run, f"id {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings(), modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted``. A NULL ID is not held out."""
    model = fit(docs, labels, key_remainder("doc_id", modulus) == held_out, s)
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(key_remainder("id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

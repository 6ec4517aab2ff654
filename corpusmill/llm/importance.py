"""Importance resampling towards a target corpus, over hashed runs of words.

A table of 256 bytes lower-cases A-Z and blanks every separator of a UTF-8 text, so that
``bytes.split`` yields the words. A run of words is hashed by CRC-32, seeded with that of the
run without its last word: longer runs cost one short call each, and no run is ever joined
into a string. Runs are counted per bucket of the hash, once for the raw documents and once
for the target; a Counter per task comes before the shuffle. The logarithm of the smoothed
ratio of both counts is the gain of a bucket, the floored mean gain of its runs the weight
of a document, and Gumbel noise of its ID turns weights into a draw without replacement.

Only counts per bucket reach the driver; their number is a parameter, not a size of the data.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import ship_package, stage, unused_name
from corpusmill.plans.prefix import dense_positions

# Bytes of a text that are split into words at once; longer texts are taken in pieces.
PIECE_BYTES = 1 << 20
ROWS_AT_A_TIME = 500


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``longest`` words in ``buckets``; ``percent`` of texts with ``min_words`` are drawn."""

    longest: int = 2
    buckets: int = 10_000
    percent: int = 25
    min_words: int = 20
    seed: int = 7


def byte_table() -> bytes:
    """Small letter of A-Z, a blank for other ASCII but digits and a-z, all else as it is."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


TABLE = byte_table()


def word_pieces(text: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text in order, a bounded stretch of it at a time."""
    plain = text.translate(TABLE)
    if len(plain) <= piece:
        yield plain.split()
        return
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + piece)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def hashed_runs(text: bytes, longest: int, piece: int = PIECE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """(length, CRC-32 of each run of so many words joined by spaces), piece by piece."""
    tail: list[bytes] = []
    for fresh in word_pieces(text, piece):
        words, old = tail + fresh, len(tail)
        seeds = list(map(crc32, words))
        yield 1, seeds[old:]
        for length in range(2, longest + 1):
            seeds = list(map(crc32, words[length - 1 :], map(crc32, repeat(b" "), seeds)))
            yield length, seeds[max(0, old - length + 1) :]
        tail = words[1 - longest :] if longest > 1 else []


def gains_of(target: dict[int, int], raw: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln of the smoothed ratio) for each bucket, in doubles."""
    of_target, of_raw = float(sum(target.values()) + buckets), float(sum(raw.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * of_raw / ((raw.get(b, 0) + 1) * of_target)))
        for b in range(buckets)
    ]


def noise_of(doc_id: int | str | None, seed: int) -> int:
    """floor(1000 times Gumbel noise) that the seed and the ID decide; a NULL ID is spelled empty."""
    spelled = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(spelled.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def bucket_counts(texts: DataFrame, text_col: str, settings: Resampling) -> DataFrame:
    """(bucket, n): how many runs of all texts fall into each bucket that has any."""
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in hashed_runs(text.as_py() or b"", settings.longest):
                    total.update((np.array(hashes, np.uint32) % settings.buckets).tolist())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(total.keys(), pa.int32()), "n": pa.array(total.values(), pa.int64())}
        )

    partial = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket int, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_gains(docs: DataFrame, target: DataFrame, settings: Resampling, text_col: str = "text", target_col: str = "text") -> list[int]:
    """Gain of every bucket, from all documents and all target texts."""
    raw = {r.bucket: r.n for r in bucket_counts(docs, text_col, settings).collect()}
    wanted = {r.bucket: r.n for r in bucket_counts(target, target_col, settings).collect()}
    return gains_of(wanted, raw, settings.buckets)


def with_scores(docs: DataFrame, gains: list[int], settings: Resampling, id_col: str, text_col: str, names: tuple[str, str, str, str]) -> DataFrame:
    """All columns, and those of ``names``: words, runs, weight and noisy score, all long."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(shared.value, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                rows = []
                for doc_id, text in zip(part.column(id_col), part.column(text_col)):
                    n_words = n_runs = total = 0
                    raw = text.as_py() or b""
                    for length, hashes in hashed_runs(raw.encode() if isinstance(raw, str) else raw, settings.longest):
                        n_words += len(hashes) if length == 1 else 0
                        n_runs += len(hashes)
                        total += int(gain[np.array(hashes, np.uint32) % settings.buckets].sum())
                    weight = total // n_runs if n_runs else 0
                    rows.append((n_words, n_runs, weight, weight + noise_of(doc_id.as_py(), settings.seed)))
                added = [pa.array(values, pa.int64()) for values in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)

    return docs.mapInArrow(score, schema)


def _drawn(eligible: DataFrame, quota: int, score: str, doc_id: str) -> DataFrame:
    """``eligible`` with ``rank``: 1, 2, 3... by descending score, then ID, NULL beyond the quota."""
    turned = eligible.withColumn("_turned", -F.col(score))
    placed = dense_positions(turned, [], ["_turned", doc_id], "_place")
    rank = F.when(F.col("_place") < quota, F.col("_place") + 1).cast("bigint")
    return placed.select(*eligible.columns, rank.alias("rank"))


def rank_documents(
    docs: DataFrame,
    target: DataFrame,
    settings: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Per document its runs, weight, noisy score, and rank in the draw (NULL if not drawn).

    A NULL text counts as empty; a text without words has no runs and weight 0. Repeated
    rows count once each, in the corpus counts as in the draw. Rows of equal score are
    ranked by ID, NULL first; rows equal in both take successive ranks in any order. Of an
    empty table nothing is drawn, and without target texts gains come from smoothing alone.
    Ranks are positions in range-partitioned slices: no task sorts all documents.
    """
    return _ranked(docs, fit_gains(docs, target, settings, text_col, target_col), settings, id_col, text_col)


def _ranked(docs: DataFrame, gains: list[int], settings: Resampling, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = ("n_words", "n_features", "weight", "score")
    scored = stage(with_scores(narrow, gains, settings, "doc_id", "text", names).drop("text"), "scored").df
    long_enough = F.col("n_words") >= settings.min_words
    eligible = scored.where(long_enough)
    quota = settings.percent * eligible.count() // 100
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return _drawn(eligible, quota, "score", "doc_id").select(*columns).unionByName(rest.select(*columns))


def resample(
    docs: DataFrame,
    target: DataFrame,
    settings: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """The drawn documents with all their columns, whatever their names.

    The same draw as ``rank_documents``: the last drawn (score, ID) is found over narrow
    rows, and each document compares its own with it, so that texts are not shuffled. Rows
    equal in score and ID stand or fall together, also where the quota ends between them.
    """
    gains = fit_gains(docs, target, settings, text_col, target_col)
    ranked = _ranked(docs, gains, settings, id_col, text_col).where("rank is not null")
    last = ranked.orderBy(F.col("rank").desc()).first()
    if last is None:
        return docs.limit(0)
    names = tuple(unused_name(docs, base) for base in ("n_words", "n_features", "weight", "score"))
    scored = with_scores(docs, gains, settings, id_col, text_col, names)
    n_words, score = F.col(f"`{names[0]}`"), F.col(f"`{names[3]}`")
    doc_id = F.col(f"`{id_col}`")
    in_time = doc_id.isNull() if last.doc_id is None else doc_id.isNull() | (doc_id <= F.lit(last.doc_id))
    drawn = (n_words >= settings.min_words) & ((score > last.score) | ((score == last.score) & in_time))
    return scored.where(drawn).select(*[F.col(f"`{c}`") for c in docs.columns])

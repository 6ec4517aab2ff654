"""A corpus from raw documents to token IDs: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, exact_dedup, minhash, mixing, toxicity
from corpusmill.llm.common import stage, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Wanted shares of tokens.
TARGETS = {"en": 0.50, "de": 0.16, "fr": 0.16, "es": 0.12, "junk": 0.06}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    index = exact_dedup.DigestIndex.scratch(spark)
    return exact_dedup.drop_exact_duplicates(docs.select(*COLUMNS), index)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that domains have the wanted shares of tokens."""
    return mixing.resample(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), TARGETS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token IDs of each text, and the text they decode to."""
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", keep_one_copy),
    ("MinHash near-dedup", keep_one_near_copy),
    ("mixing to target weights", mix_to_targets),
    ("BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_")).df
    return STAGES[-1][1](spark, docs, sf_dir)


# The toxicity model, near-duplicates and mixing rates are fitted iteratively, which SQL does not express.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

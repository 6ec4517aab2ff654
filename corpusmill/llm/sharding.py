"""Rendezvous hashing over weighted shards.

Each key scores every shard by -weight / ln(u), where u in (0, 1) comes from a hash of key
and shard, and goes to the shard with the highest score. A shard gets keys in proportion to
its weight; adding a shard moves only keys that the new shard wins, removing one moves only
its own. The hash is MD5 of "key:shard", so that any engine can repeat the placement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import own_names, whole_text
from corpusmill.plans.prefix import running_totals

OVERHEAD_BYTES = 16


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Score of one shard for a key; the first 48 bits of the hash, centred, stand for u."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((drawn + 0.5) / F.lit(float(2**48)))


def choose_shard(key: Column, weights: Sequence[float], grown: Sequence[float] = ()) -> Column:
    """Struct of ``shard`` over ``weights`` and ``grown_shard`` over ``weights`` and ``grown``.

    Shards of weight 0 get nothing. Equal scores go to the lower shard number.
    """
    if not weights or min([*weights, *grown]) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, and one of the first must be positive")

    def best(numbers: Sequence[int], all_weights: Sequence[float]) -> Column:
        scored = [
            F.struct(shard_score(key, n, all_weights[n]).alias("score"), F.lit(-n).alias("rank"))
            for n in numbers
            if all_weights[n] > 0
        ]
        return F.array_max(F.array(*scored))

    first = range(len(weights))
    every = [*weights, *grown]
    later = [n for n in range(len(weights), len(every)) if every[n] > 0]

    def both(old: Column) -> Column:
        new = F.greatest(old, best(later, every)) if later else old
        return F.struct((-old["rank"]).alias("shard"), (-new["rank"]).alias("grown_shard"))

    return F.element_at(F.transform(F.array(best(first, weights)), both), 1)


def with_slots(placed: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, in ``order``.

    Ranks come from range-partitioned slices shifted by the counts of earlier slices, so a
    shard may be larger than a task.
    """
    counted = placed.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(counted, [shard], [F.col(c) for c in order], ["_one"])
    return ranked.select(*placed.columns, F.col("_one_before").cast("bigint").alias("slot"))


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    weights: Sequence[float] | None = None,
    added: Sequence[float] = (1.0,),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One narrow row per document: size, CRC-32 of the text, shard, slot, shard after growth.

    The law is ``key``: ID and shards decide, whatever the text. A NULL text counts as empty.
    Rows with a NULL ID share the key "null", so all of them go to one shard, in many slices.
    Repeated rows stay rows of their own, each with its own slot.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = whole_text(text_col).cast("binary")
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        choose_shard(key, weights, added).alias("_to"),
    ).select(
        "doc_id", "size", "text_crc32", "law", F.col("_to.shard").alias("shard"), F.col("_to.grown_shard").alias("grown_shard")
    )
    numbered = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return own_names(numbered, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

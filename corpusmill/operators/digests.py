"""Comparison of tables by a tree of digests: rows are joined only where digests differ.

Keys are dealt to buckets by hash. A bucket's digest does not depend on the order of its
rows: the count, and sums of three hashes of key and value. Digests add up, level by level,
to the root; equal roots end a comparison without reading a row again. Stored trees of
unchanged tables make even the scan unnecessary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.materialize import materialize

# Children of a node, and levels below the root: 16^3 buckets.
FAN_OUT = 16
LEVELS = 3
# Sums of this many hashes; two tables that differ agree in all by chance once in 2^180.
SEEDS = (11, 23, 37)
DIGEST = ["n", *[f"h{i}" for i in range(len(SEEDS))]]


def bucket_of(keys: Sequence[str]) -> Column:
    """Number of a key's bucket; NULL is a value of its own."""
    return F.pmod(F.xxhash64(*_marked(keys)), F.lit(FAN_OUT**LEVELS))


def _marked(columns: Sequence[str]) -> list[Column]:
    # xxhash64 passes over NULLs: a mark tells them apart. As strings, numbers of any width are equal.
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]


def digest_tree(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("label",)) -> DataFrame:
    """(level, node, n, h0, h1, h2): stored digests of all nodes that have rows, level 0 the root.

    One scan with partial sums; the result has at most 4,369 rows, whatever the table.
    """
    hashes = [F.sum(F.xxhash64(F.lit(seed), *_marked([*keys, *values])).cast("decimal(20,0)")).alias(f"h{i}") for i, seed in enumerate(SEEDS)]
    leaves = df.groupBy(bucket_of(keys).alias("node")).agg(F.count("*").alias("n"), *hashes)
    nodes = leaves.select(
        F.inline(
            F.transform(
                F.sequence(F.lit(0), F.lit(LEVELS)),
                lambda level: F.struct(
                    level.alias("level"),
                    F.floor(F.col("node") / F.pow(F.lit(FAN_OUT), F.lit(LEVELS) - level)).cast("bigint").alias("node"),
                    *[F.col(c).alias(c) for c in DIGEST],
                ),
            )
        )
    )
    return materialize(nodes.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in DIGEST]))


def differing_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Buckets whose digests differ, found from the root down; at most 4,096."""
    suspects: list[int] | None = None
    for level in range(LEVELS + 1):
        here = []
        for tree in (left, right):
            nodes = tree.where(F.col("level") == level)
            if suspects is not None:
                nodes = nodes.where(F.floor(F.col("node") / FAN_OUT).isin(suspects))
            here.append({r.node: tuple(r[c] for c in DIGEST) for r in nodes.collect()})
        suspects = [n for n in sorted({*here[0], *here[1]}) if here[0].get(n) != here[1].get(n)]
        if not suspects:
            return []
    return suspects

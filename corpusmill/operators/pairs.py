"""Texts and their counterparts: unique texts, pending work, swaps, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """First row per key in ``order``; merged map-side, a hot key is no window."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Last row per key in ``order``."""
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys: Sequence[str], order: str | Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def unique_texts(
    rows: DataFrame, id_col: str = "file_id", text: str = "text", line: str | None = None
) -> DataFrame:
    """One text per ID: the first by task, then train before test, then by ``line``."""
    order = [F.col("task"), (F.col("split") != "train").alias("late"), *([F.col(line)] if line else [])]
    ordered = rows.select(id_col, text, F.struct(*order).alias("_order"))
    return keep_first(ordered, [id_col], "_order").drop("_order")


def pending(texts: DataFrame, done: DataFrame, limit: int | None = None, id_col: str = "file_id") -> DataFrame:
    """Texts without a stored counterpart; ``limit`` takes the first by ID for a pilot run."""
    todo = texts.join(done.select(id_col), id_col, "left_anti")
    return todo if limit is None else todo.orderBy(id_col).limit(limit)


def swap_text(
    rows: DataFrame, pairs: DataFrame, id_col: str = "file_id", text: str = "text", order: str | None = None
) -> DataFrame:
    """Dataset rows with the counterpart text; all other columns unchanged.

    Fails on a row without counterpart. Of several counterparts of one ID the last in
    ``order`` counts, or the largest text.
    """
    other = keep_last(pairs.select(id_col, F.col("out").alias("_out"), *([order] if order else [])), [id_col], order or "_out")
    joined = rows.join(other.select(id_col, "_out", F.lit(True).alias("_paired")), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no counterpart text for "), F.col(id_col).cast("string"))).cast("string")
    swapped = F.when(F.col("_paired"), F.col("_out")).otherwise(missing)
    return joined.select(*[swapped.alias(text) if c == text else F.col(c) for c in rows.columns])


def upsert_pairs(
    stored: DataFrame, redone: DataFrame, order: str = "seq", id_col: str = "file_id"
) -> DataFrame:
    """Stored records with redone ones in their place.

    Stored duplicates collapse to the first, redone ones to the last. Redone records take over
    the position of the record they replace, and new ones follow behind. Write the result to a new path
    before swapping it in: Spark cannot overwrite what it reads.
    """
    payload = [c for c in stored.columns if c not in (id_col, order)]
    old = keep_first(stored, [id_col], order).select(
        id_col, F.col(order).alias("_old_order"), F.struct(*payload).alias("_old")
    )
    new = keep_last(redone, [id_col], order).select(id_col, F.col(order).alias("_new_order"), F.struct(*payload).alias("_new"))
    merged = old.join(new, id_col, "full_outer")
    return merged.select(
        id_col,
        F.coalesce("_old_order", "_new_order").alias(order),
        F.col("_old_order").isNull().alias("appended"),
        F.col("_new").isNotNull().alias("replaced"),
        F.coalesce("_new", "_old").alias("_row"),
    ).select(id_col, order, "appended", "replaced", "_row.*")

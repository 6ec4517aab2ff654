"""Label merging with three-valued OR, exclusion, split manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import json_text
from corpusmill.plans.materialize import small_lookup
from corpusmill.plans.prefix import dense_positions

Groups = Mapping[str, Sequence[str]]


def last_labels(rows: DataFrame, order: str | Column = "seq", keys: Sequence[str] = ("file_id", "task")) -> DataFrame:
    """One label per key: the last in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by("label", order).alias("label"))


def exclude_ids(rows: DataFrame, ids: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Rows whose ID is not listed."""
    return rows.join(ids.select(id_col), id_col, "left_anti")


def _groups_of(task: Column, groups: Groups) -> Column:
    """Array of the groups a task belongs to."""
    return F.array_compact(
        F.array(*[F.when(task.isin(*parts), F.lit(name)) for name, parts in groups.items()])
    )


def _group_size(group: Column, groups: Groups) -> Column:
    out = None
    for name, parts in groups.items():
        size = F.lit(len(set(parts)))
        out = F.when(group == name, size) if out is None else out.when(group == name, size)
    return out


def merge_labels(labels: DataFrame, groups: Groups, id_col: str = "file_id") -> DataFrame:
    """OR of the component labels per ID and group, from one row per ID and task.

    1 if any is 1; 0 if all components are there and 0; NULL if a missing one would decide.
    IDs without any component of a group have no row for it.
    """
    present = labels.withColumn("merged_task", F.explode(_groups_of(F.col("task"), groups)))
    state = present.groupBy("merged_task", id_col).agg(
        F.max("label").alias("_max"), F.count("*").alias("n_present")
    )
    complete = F.col("n_present") == _group_size(F.col("merged_task"), groups)
    merged = F.when(F.col("_max") == 1, 1).when(complete, 0)
    return state.select("merged_task", id_col, "n_present", merged.cast("int").alias("label"))


def determined(merged: DataFrame) -> DataFrame:
    return merged.where("label is not null")


def merged_counts(
    labels: DataFrame, groups: Groups, excluded: DataFrame, id_col: str = "file_id"
) -> DataFrame:
    """Kept, undetermined and excluded IDs of each group."""
    marks = excluded.select(id_col).distinct().withColumn("_out", F.lit(True))
    merged = merge_labels(labels, groups, id_col).join(marks, id_col, "left")
    out, known = F.col("_out").isNotNull(), F.col("label").isNotNull()
    return merged.groupBy("merged_task").agg(
        F.count_if(~out & known).alias("n_kept"),
        F.count_if(~out & ~known).alias("n_dropped_undetermined"),
        F.count_if(out).alias("n_excluded"),
        F.count_if(~out & (F.col("label") == 1)).alias("n_pos"),
    )


def split_manifest(
    rows: DataFrame,
    group: str = "merged_task",
    id_col: str = "file_id",
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """IDs of every group and split at their sorted places, with sizes and settings.

    One line per ID at any size. The number of groups and splits is that of a registry.
    """
    cell = [group, "split"]
    ids = rows.select(*cell, F.col(id_col).cast("string").alias(id_col))
    sizes = ids.groupBy(*cell).agg(F.count("*").alias("n_ids"))
    return dense_positions(ids, cell, [id_col]).join(small_lookup(sizes), cell).select(
        *cell, "position", id_col, "n_ids", F.lit(float(test_size)).alias("test_size"), F.lit(seed).alias("seed")
    )


SECTIONS = ("excluded", "train", "test")


def manifest_ids(rows: DataFrame, excluded: DataFrame, merged: DataFrame, group: str = "merged_task", id_col: str = "file_id") -> DataFrame:
    """(group, section, position, ID): the IDs of each split, and the excluded ones that have a label in the group.

    ``rows`` are the split rows, ``merged`` the merged labels of all IDs before exclusion.
    """
    out = merged.join(excluded.select(id_col).distinct(), id_col, "left_semi")
    listed = rows.select(group, F.col("split").alias("section"), F.col(id_col).cast("string").alias(id_col)).unionByName(
        out.select(group, F.lit("excluded").alias("section"), F.col(id_col).cast("string").alias(id_col))
    )
    return dense_positions(listed, [group, "section"], [id_col])


def manifest_fragments(
    ids: DataFrame,
    counts: DataFrame,
    groups: Groups,
    test_size: float = 0.2,
    seed: int = 42,
    exclusion_list: str | None = None,
    group: str = "merged_task",
    id_col: str = "file_id",
) -> DataFrame:
    """(document, section_no, position, fragment): the manifest of each group as pieces of one JSON document.

    ``ids`` comes from ``manifest_ids``, ``counts`` from ``merged_counts``. A line holds one
    ID, so a list of any length is spread over tasks; joined in order the pieces are valid JSON.
    """
    parts = F.create_map(*[F.lit(x) for name, tasks in groups.items() for x in (name, json.dumps(list(tasks)))])
    document = F.concat(F.col(group), F.lit(".json"))
    head = F.concat(
        F.lit('{"group": '), json_text(F.col(group)),
        F.lit(', "components": '), parts[F.col(group)],
        *[x for c in ("n_kept", "n_dropped_undetermined", "n_excluded") for x in (F.lit(f', "{c}": '), F.col(c).cast("string"))],
        F.lit(f', "exclusion_list": {json.dumps(exclusion_list)}, "test_size": {json.dumps(test_size)}, "seed": {json.dumps(seed)}, "excluded_file_ids": ['),
    )
    # Even numbers are frames around the lists, odd ones their IDs.
    frames = {0: head, 2: F.lit('], "splits": {"train": ['), 4: F.lit('], "test": ['), 6: F.lit("]}}\n")}
    framed = counts.select(
        document.alias("document"),
        F.inline(F.array(*[F.struct(F.lit(no).alias("section_no"), text.alias("fragment")) for no, text in frames.items()])),
    ).withColumn("position", F.lit(0).cast("bigint"))
    number = F.create_map(*[F.lit(x) for at, section in enumerate(SECTIONS) for x in (section, 2 * at + 1)])
    between = F.when(F.col("position") > 0, ",\n").otherwise("\n")
    listed = ids.select(
        document.alias("document"),
        number[F.col("section")].alias("section_no"),
        F.concat(between, json_text(F.col(id_col))).alias("fragment"),
        "position",
    )
    return framed.unionByName(listed)

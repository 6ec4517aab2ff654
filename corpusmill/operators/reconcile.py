"""Metadata rows that share an ID: agreement, conflicts, usable files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.labels import clean_labels
from corpusmill.operators.matching import explode_ids, valid_files
from corpusmill.plans.materialize import broadcast_if_small, materialize
from corpusmill.plans.prefix import dense_positions

# Lines of an ID that one task may sort among others.
LIST_ROWS = 100_000


def label_rows(
    meta: DataFrame, labels: Sequence[str], cell: str = "matched_ids", strip_values: bool = True
) -> DataFrame:
    """Metadata rows per ID and distinct label tuple: ``n`` rows each.

    Counting equal tuples first keeps an ID with very many rows spread over all tasks.
    """
    cleaned = clean_labels(meta.select(cell, *labels), labels, strip_values)
    return explode_ids(cleaned, cell).groupBy("file_id", *labels).agg(F.count("*").alias("n"))


def id_agreement(
    meta: DataFrame, labels: Sequence[str], cell: str = "matched_ids", strip_values: bool = True
) -> DataFrame:
    """Per ID: number of rows, number of distinct label tuples, and the smallest tuple."""
    return (
        label_rows(meta, labels, cell, strip_values)
        .groupBy("file_id")
        .agg(
            F.sum("n").alias("n_metadata_rows"),
            F.count("*").alias("n_signatures"),
            F.min(F.struct(*labels)).alias("_labels"),
        )
    )


def usable_matches(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    cell: str = "matched_ids",
    strip_values: bool = True,
) -> DataFrame:
    """Files whose metadata rows all carry the same labels."""
    agreed = id_agreement(meta, labels, cell, strip_values).where("n_signatures = 1")
    kind = F.when(F.col("n_metadata_rows") == 1, "single_row").otherwise("multi_row_identical")
    return valid_files(files).join(agreed, "file_id").select(
        "text_file", "file_id", "n_metadata_rows", kind.alias("match_type"), "_labels.*"
    )


def _matched(files: DataFrame, ids: DataFrame) -> DataFrame:
    per_id = valid_files(files).groupBy("file_id").agg(F.count("*").alias("n_files"))
    return per_id.join(ids, "file_id")


def rows_per_file(files: DataFrame, meta: DataFrame, cell: str = "matched_ids") -> DataFrame:
    """Matched files by one or many metadata rows."""
    rows = explode_ids(meta.select(cell), cell).groupBy("file_id").agg(F.count("*").alias("n_rows"))
    kind = F.when(F.col("n_rows") == 1, "single_row").otherwise("multiple_rows")
    return _matched(files, rows).groupBy(kind.alias("row_kind")).agg(F.sum("n_files").alias("n_files"))


def label_agreement(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    cell: str = "matched_ids",
    strip_values: bool = True,
) -> DataFrame:
    """Matched files with several rows, by identical or conflicting labels."""
    ids = id_agreement(meta, labels, cell, strip_values).drop("_labels")
    kind = F.when(F.col("n_signatures") == 1, "identical").otherwise("conflicting")
    many = _matched(files, ids).where("n_metadata_rows > 1")
    return many.groupBy(kind.alias("agreement")).agg(F.sum("n_files").alias("n_files"))


def conflict_details(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    cell: str = "matched_ids",
    strip_values: bool = True,
) -> DataFrame:
    """Distinct label tuples of every file in conflict, numbered in sorted order.

    The file name stands on the first line only, the total of rows on each. Numbers come
    from running totals, so one ID may have any number of tuples.
    """
    tuples = label_rows(meta, labels, cell, strip_values)
    ids = tuples.groupBy("file_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("_variants"))
    ids = ids.where("_variants > 1").drop("_variants")
    of_conflicts = tuples.join(ids, "file_id").select("file_id", "n_rows", *labels)
    numbered = dense_positions(of_conflicts, ["file_id"], labels).withColumn(
        "distinct_label_tuple", (F.col("position") + 1).cast("int")
    )
    name = F.when(F.col("distinct_label_tuple") == 1, F.col("text_file")).otherwise("")
    return valid_files(files).join(numbered, "file_id").select(
        "file_id", name.alias("text_file"), "n_rows", "distinct_label_tuple", *labels
    )


def id_summary(
    files: DataFrame, meta: DataFrame, labels: Sequence[str], row: str, cell: str, strip_values: bool
) -> DataFrame:
    """Per ID with files and metadata: first file, numbers of files, rows and label tuples, first labels.

    Files and metadata rows are counted apart; no file is paired with a row for it.
    """
    cleaned = clean_labels(meta.select(row, cell, *labels), labels, strip_values)
    tuples = explode_ids(cleaned, cell).groupBy("file_id", *labels).agg(
        F.count("*").alias("n"), F.min(F.struct(row, cell)).alias("_first")
    )
    ids = tuples.groupBy("file_id").agg(
        F.sum("n").alias("_n_rows"),
        F.count("*").alias("n_variants"),
        F.min(F.struct("_first", *labels)).alias("_kept"),
    )
    per_id = valid_files(files).groupBy("file_id").agg(F.count("*").alias("n_files"), F.min("text_file").alias("text_file"))
    return per_id.join(ids, "file_id").withColumn("row_count", F.col("n_files") * F.col("_n_rows")).drop("_n_rows")


def listed_rows(files: DataFrame, meta: DataFrame, ids: DataFrame, row: str, cell: str) -> DataFrame:
    """One line per file and metadata row of the given IDs, at its place in input order.

    ``ids`` is a stored table of ``id_summary``. ``first_of_cell`` marks the first line of each
    distinct cell. A list of any length has this one shape; only rows of the given IDs are paired
    with files. Lists of up to ``LIST_ROWS`` lines are numbered where their ID is joined; longer
    ones are spread over all tasks.
    """
    rows, names = explode_ids(meta.select(row, cell), cell), valid_files(files).select("text_file", "file_id")
    columns = ["file_id", "position", row, cell]
    long = ids.where(F.col("row_count") > LIST_ROWS).select("file_id")
    if long.isEmpty():
        return _listed_by_id(names, rows, ids, row, cell)
    # At most one ID per LIST_ROWS lines.
    long = broadcast_if_small(materialize(long))
    paired = names.join(rows.join(long, "file_id", "left_semi"), "file_id")
    # Written once: the first places and the lines themselves both read it.
    placed = materialize(dense_positions(paired, ["file_id"], ["text_file", row, cell]))
    firsts = placed.groupBy("file_id", cell).agg(F.min("position").alias("_first_at"))
    spread = placed.join(firsts, ["file_id", cell]).select(
        *columns, (F.col("position") == F.col("_first_at")).alias("first_of_cell")
    )
    short = ids.where(F.col("row_count") <= LIST_ROWS)
    return _listed_by_id(names, rows.join(long, "file_id", "left_anti"), short, row, cell).unionByName(spread)


def _listed_by_id(names: DataFrame, rows: DataFrame, ids: DataFrame, row: str, cell: str) -> DataFrame:
    """``listed_rows`` of IDs with short lists: one shuffle by ID, and two sorts within it."""
    paired = names.join(rows.join(ids.select("file_id"), "file_id", "left_semi"), "file_id")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("text_file", row, cell)) - 1
    placed = paired.select("file_id", row, cell, place.cast("bigint").alias("position"))
    of_cell = F.row_number().over(Window.partitionBy("file_id", cell).orderBy("position"))
    return placed.select("file_id", "position", row, cell, (of_cell == 1).alias("first_of_cell"))


def duplicate_summary(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    row: str = "metadata_row",
    cell: str = "matched_ids",
    strip_values: bool = False,
) -> DataFrame:
    """Every row of the IDs with several: its place, the counts, labels of the first metadata row."""
    # Written once: the lists and the columns of their IDs both read it.
    ids = materialize(id_summary(files, meta, labels, row, cell, strip_values).where("row_count > 1"))
    return listed_rows(files, meta, ids, row, cell).join(ids, "file_id").select(
        "file_id",
        "position",
        row,
        cell,
        "first_of_cell",
        "row_count",
        F.col("n_variants").alias("unique_prediction_count"),
        (F.col("n_variants") == 1).alias("predictions_same"),
        *[f"_kept.{c}" for c in labels],
    )


def _csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), _doubled(value), F.lit('"'))


def _doubled(value: Column) -> Column:
    return F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""'))


def summary_fragments(
    summary: DataFrame,
    labels: Sequence[str],
    document: str = "duplicate_summary.csv",
    row: str = "metadata_row",
    cell: str = "matched_ids",
) -> DataFrame:
    """(document, id_size, file_id, section, position, fragment): the summary as a CSV file with a line per ID.

    ``summary`` comes from ``duplicate_summary``. Row numbers are joined by commas and distinct
    cells by `` | ``, each list entry a fragment of its own, so that a line of any length is
    spread over tasks. Written in this order, lines ascend by numeric ID below the header.
    """
    first, name = F.col("position") == 0, F.lit(document).alias("document")
    head = F.concat_ws(
        ",",
        _csv_cell(F.col("file_id")),
        F.col("row_count").cast("string"),
        F.col("unique_prediction_count").cast("string"),
        F.col("predictions_same").cast("string"),
        F.lit('"'),
    )
    tail = F.concat(F.lit('",'), F.concat_ws(",", *[_csv_cell(F.col(f"`{c}`")) for c in labels]), F.lit("\n"))
    pieces = [
        (1, F.when(first, head)),
        (2, F.concat(F.when(first, "").otherwise(","), F.col(row).cast("string"))),
        (3, F.when(first, '","')),
        (4, F.when(F.col("first_of_cell"), F.concat(F.when(first, "").otherwise(" | "), _doubled(F.col(cell))))),
        (5, F.when(first, tail)),
    ]
    structs = F.array(*[F.struct(F.lit(at).alias("section"), text.alias("fragment")) for at, text in pieces])
    lines = summary.select(
        name, F.length("file_id").alias("id_size"), "file_id", "position", F.inline(structs)
    ).where("fragment is not null")
    columns = ["file_id", "row_count", "unique_prediction_count", "predictions_same", "metadata_rows", "matched_ids_values", *labels]
    header = summary.sparkSession.createDataFrame(
        [(document, 0, "", 0, 0, ",".join(columns) + "\n")],
        "document string, id_size int, file_id string, position bigint, section int, fragment string",
    )
    return header.unionByName(lines)


def usable_labels(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    row: str = "metadata_row",
    cell: str = "matched_ids",
    strip_values: bool = False,
) -> DataFrame:
    """Every row of the IDs whose rows agree: its place, first file, how it was matched, the labels."""
    # Written once: the lists and the columns of their IDs both read it.
    ids = materialize(id_summary(files, meta, labels, row, cell, strip_values).where("n_variants = 1"))
    status = F.when(F.col("row_count") == 1, "single_match").otherwise("duplicate_same_labels")
    return listed_rows(files, meta, ids, row, cell).join(ids, "file_id").select(
        "text_file",
        "file_id",
        "position",
        row,
        cell,
        "first_of_cell",
        status.alias("source_match_status"),
        F.col("row_count").alias("source_row_count"),
        *[f"_kept.{c}" for c in labels],
    )


def usable_statistics(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    row: str = "metadata_row",
    cell: str = "matched_ids",
    strip_values: bool = False,
) -> DataFrame:
    """One row: matched rows, IDs, and IDs by single match, agreement and conflict."""
    ids = id_summary(files, meta, labels, row, cell, strip_values).select(F.col("row_count").alias("n"), F.col("n_variants").alias("k"))
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count("*").alias("matched_ids"),
        F.count_if(F.col("n") == 1).alias("single_match_ids"),
        F.count_if((F.col("n") > 1) & (F.col("k") == 1)).alias("duplicate_same_label_ids"),
        F.count_if(F.col("k") > 1).alias("duplicate_conflict_ids"),
        F.count_if(F.col("k") == 1).alias("usable_ids"),
    )


def label_mismatches(
    files: DataFrame,
    meta: DataFrame,
    labels: Sequence[str],
    row: str = "metadata_row",
    cell: str = "matched_ids",
    strip_values: bool = False,
) -> DataFrame:
    """All rows of IDs in conflict, with the number of their label tuple by first appearance.

    Only metadata rows of such IDs are paired with files.
    """
    rows = explode_ids(clean_labels(meta, labels, strip_values), cell)
    tuples = rows.groupBy("file_id", *labels).agg(F.min(row).alias("_first_row"))
    several = tuples.groupBy("file_id").agg(F.count("*").alias("_variants")).where("_variants > 1").select("file_id")
    variants = dense_positions(tuples.join(several, "file_id", "left_semi"), ["file_id"], ["_first_row", *labels]).select(
        "file_id", *labels, (F.col("position") + 1).cast("int").alias("prediction_variant_index")
    )
    return valid_files(files).join(rows.join(variants, ["file_id", *labels]), "file_id")

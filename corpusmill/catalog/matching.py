"""Queries on files, metadata rows and label agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.views import LABELS, with_views
from corpusmill.functions.ids import id_order, normalize_id
from corpusmill.functions.text import slug
from corpusmill.operators import matching, profiles, reconcile


def _by_id(df, *more):
    return df.orderBy(*id_order("file_id"), *more)


def _usable(spark, d):
    return reconcile.usable_matches(v.text_files(spark, d), v.metadata(spark, d), LABELS)


def normalize_id_query(spark, d):
    cells = v.metadata(spark, d).select("metadata_row", F.posexplode(F.split("matched_ids", ",")).alias("pos", "token"))
    return cells.select("metadata_row", "pos", "token", normalize_id("token").alias("id"))


QUERIES = {
    "normalize_id": normalize_id_query,
    "extract_file_id": v.text_files,
    "task_slug": lambda s, d: v.file_names(s, d).select("text_file", slug("text_file").alias("slug")),
    "explode_ids": lambda s, d: matching.explode_ids(v.metadata(s, d)).select("metadata_row", "file_id"),
    "match_files": lambda s, d: matching.match_files(v.text_files(s, d), v.metadata(s, d)),
    "unmatched_report": lambda s, d: matching.unmatched_files(v.text_files(s, d), v.metadata(s, d)),
    "match_summary": lambda s, d: matching.match_summary(v.text_files(s, d), v.metadata(s, d)),
    "usable_matches": _usable,
    "rows_per_file": lambda s, d: reconcile.rows_per_file(v.text_files(s, d), v.metadata(s, d)),
    "label_agreement": lambda s, d: reconcile.label_agreement(v.text_files(s, d), v.metadata(s, d), LABELS),
    "conflict_details": lambda s, d: _by_id(
        reconcile.conflict_details(v.text_files(s, d), v.metadata(s, d), LABELS), "distinct_label_tuple"
    ),
    "duplicate_summary": lambda s, d: reconcile.duplicate_summary(v.text_files(s, d), v.metadata(s, d), LABELS),
    "usable_labels": lambda s, d: reconcile.usable_labels(v.text_files(s, d), v.metadata(s, d), LABELS),
    "usable_statistics": lambda s, d: reconcile.usable_statistics(v.text_files(s, d), v.metadata(s, d), LABELS),
    "label_mismatches": lambda s, d: reconcile.label_mismatches(v.text_files(s, d), v.metadata(s, d), LABELS),
    "label_distribution": lambda s, d: profiles.label_distribution(_usable(s, d), LABELS),
    "modal_label": lambda s, d: profiles.modal_label(_usable(s, d), LABELS),
    "complete_binary_rows": lambda s, d: profiles.complete_binary_rows(_usable(s, d), LABELS),
}

_COUNTS = """SELECT prediction_column, label_value, count(*) AS count FROM (
    SELECT 'label_a' AS prediction_column, CASE WHEN trim(label_a) = '' THEN '<blank>' ELSE trim(label_a) END AS label_value FROM usable
    UNION ALL
    SELECT 'label_b', CASE WHEN trim(label_b) = '' THEN '<blank>' ELSE trim(label_b) END FROM usable) GROUP BY ALL"""
_SHARES = """SELECT *, CAST(format('{:.2f}', CAST(count AS DOUBLE) / CAST(sum(count) OVER (PARTITION BY prediction_column) AS DOUBLE) * 100) AS DOUBLE)
    AS percent FROM counts"""
_KINDS = """SELECT f.text_file, a.file_id, a.n_metadata_rows, a.k FROM files f JOIN agreed a ON f.file_id = a.file_id"""
_ORDERED = "ORDER BY text_file, metadata_row"
_PLACED = f"""SELECT file_id, metadata_row, matched_ids,
    row_number() OVER (PARTITION BY file_id {_ORDERED}, matched_ids) - 1 AS position FROM matches"""

ORACLES = {
    "normalize_id": with_views(
        """SELECT metadata_row, CAST(pos - 1 AS INTEGER) AS pos, tokens[pos] AS token,
            regexp_extract(trim(tokens[pos]), '^([0-9]+)(\\.0+)?$', 1) AS id
        FROM (SELECT metadata_row, tokens, unnest(range(1, len(tokens) + 1)) AS pos
            FROM (SELECT metadata_row, string_split(matched_ids, ',') AS tokens FROM meta))""",
        "meta",
    ),
    "extract_file_id": with_views("SELECT text_file, file_id FROM files", "files"),
    "task_slug": with_views(
        "SELECT text_file, lower(trim(regexp_replace(text_file, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM text_file_names",
        "text_file_names",
    ),
    "explode_ids": with_views("SELECT metadata_row, file_id FROM ids", "ids"),
    "match_files": with_views("SELECT * FROM matches", "matches"),
    "unmatched_report": with_views(
        """SELECT text_file, file_id, 'invalid_filename_id' AS reason FROM files WHERE file_id = ''
        UNION ALL SELECT text_file, file_id, 'no_metadata_match' FROM files
        WHERE file_id <> '' AND file_id NOT IN (SELECT file_id FROM ids)""",
        "files",
        "ids",
    ),
    "match_summary": with_views(
        """SELECT count(*) AS files_scanned, count(*) FILTER (file_id = '') AS files_invalid,
            count(*) FILTER (file_id <> '') AS files_valid, count(*) FILTER (known) AS files_matched,
            count(*) FILTER (file_id <> '' AND NOT known) AS files_unmatched,
            (SELECT count(DISTINCT file_id) FROM ids) AS ids_in_metadata,
            count(DISTINCT file_id) FILTER (known) AS ids_matched,
            count(DISTINCT file_id) FILTER (file_id <> '' AND NOT known) AS ids_unmatched,
            count(DISTINCT file_id) FILTER (known AND n > 1) AS ids_with_many_rows,
            (SELECT count(*) FROM matches) AS output_rows
        FROM (SELECT f.file_id, r.n, r.n IS NOT NULL AS known FROM files f
            LEFT JOIN (SELECT file_id, count(*) AS n FROM ids GROUP BY file_id) r ON f.file_id = r.file_id)""",
        "matches",
    ),
    "usable_matches": with_views("SELECT * FROM usable", "usable"),
    "rows_per_file": with_views(
        """SELECT CASE WHEN n_metadata_rows = 1 THEN 'single_row' ELSE 'multiple_rows' END AS row_kind,
            count(*) AS n_files FROM kinds GROUP BY 1""",
        "files",
        "agreed",
        kinds=_KINDS,
    ),
    "label_agreement": with_views(
        """SELECT CASE WHEN k = 1 THEN 'identical' ELSE 'conflicting' END AS agreement, count(*) AS n_files
        FROM kinds WHERE n_metadata_rows > 1 GROUP BY 1""",
        "files",
        "agreed",
        kinds=_KINDS,
    ),
    "conflict_details": with_views(
        """SELECT t.file_id, CASE WHEN t.i = 1 THEN k.text_file ELSE '' END AS text_file,
            k.n_metadata_rows AS n_rows, CAST(t.i AS INTEGER) AS distinct_label_tuple, t.label_a, t.label_b
        FROM kinds k JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY label_a, label_b) AS i
            FROM (SELECT DISTINCT file_id, trim(label_a) AS label_a, trim(label_b) AS label_b FROM ids)) t
        ON k.file_id = t.file_id WHERE k.k > 1""",
        "files",
        "agreed",
        kinds=_KINDS,
    ),
    "duplicate_summary": with_views(
        f"""SELECT file_id, position, metadata_row, matched_ids,
            position = min(position) OVER (PARTITION BY file_id, matched_ids) AS first_of_cell, row_count,
            k AS unique_prediction_count, k = 1 AS predictions_same, label_a, label_b
        FROM placed JOIN (SELECT file_id, count(*) AS row_count, count(DISTINCT (label_a, label_b)) AS k,
            first(label_a {_ORDERED}) AS label_a, first(label_b {_ORDERED}) AS label_b
            FROM matches GROUP BY file_id HAVING count(*) > 1) USING (file_id)""",
        "matches",
        placed=_PLACED,
    ),
    "usable_labels": with_views(
        """SELECT text_file, file_id, position, metadata_row, matched_ids,
            position = min(position) OVER (PARTITION BY file_id, matched_ids) AS first_of_cell,
            CASE WHEN n = 1 THEN 'single_match' ELSE 'duplicate_same_labels' END AS source_match_status,
            n AS source_row_count, label_a, label_b
        FROM placed JOIN (SELECT file_id, min(text_file) AS text_file, count(*) AS n,
            min(label_a) AS label_a, min(label_b) AS label_b
            FROM matches GROUP BY file_id HAVING count(DISTINCT (label_a, label_b)) = 1) USING (file_id)""",
        "matches",
        placed=_PLACED,
    ),
    "usable_statistics": with_views(
        """SELECT CAST(sum(n) AS BIGINT) AS input_rows, count(*) AS matched_ids,
            count(*) FILTER (n = 1) AS single_match_ids,
            count(*) FILTER (n > 1 AND k = 1) AS duplicate_same_label_ids,
            count(*) FILTER (k > 1) AS duplicate_conflict_ids, count(*) FILTER (k = 1) AS usable_ids
        FROM (SELECT file_id, count(*) AS n, count(DISTINCT (label_a, label_b)) AS k FROM matches GROUP BY file_id)""",
        "matches",
    ),
    "label_mismatches": with_views(
        """SELECT m.text_file, m.file_id, m.metadata_row, m.matched_ids, m.label_a, m.label_b,
            CAST(t.i AS INTEGER) AS prediction_variant_index
        FROM matches m JOIN (SELECT *, count(*) OVER (PARTITION BY file_id) AS k,
                row_number() OVER (PARTITION BY file_id ORDER BY r) AS i
            FROM (SELECT file_id, label_a, label_b, min(metadata_row) AS r FROM matches GROUP BY ALL)) t
        ON m.file_id = t.file_id AND m.label_a = t.label_a AND m.label_b = t.label_b WHERE t.k > 1""",
        "matches",
    ),
    "label_distribution": with_views("SELECT * FROM shares", "usable", counts=_COUNTS, shares=_SHARES),
    "modal_label": with_views(
        """SELECT prediction_column, label_value, count, percent FROM shares
        QUALIFY row_number() OVER (PARTITION BY prediction_column ORDER BY count DESC, label_value) = 1""",
        "usable",
        counts=_COUNTS,
        shares=_SHARES,
    ),
    "complete_binary_rows": with_views(
        """SELECT * FROM usable WHERE upper(trim(label_a)) IN ('TRUE', 'FALSE')
        AND upper(trim(label_b)) IN ('TRUE', 'FALSE')""",
        "usable",
    ),
}

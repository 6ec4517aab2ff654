"""Matching and reconciliation on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import matching, profiles, reconcile
from corpusmill.operators.guards import require_columns, require_empty, require_rows

LABELS = ["a", "b"]
META = [
    (2, "1", "TRUE", "x"),
    (3, "2.0, 3", " TRUE", "x"),
    (4, "2", "TRUE", "x"),
    (5, "3", "FALSE", "x"),
    (6, "7,7", "TRUE", ""),
    (7, "3", "FALSE", "x"),
    (8, "n/a", "TRUE", "x"),
    (9, "8", "true", "x"),
    (10, "8", "TRUE", "x"),
]
FILES = ["f_1.txt", "f_2.txt", "g_2.txt", "f_3.txt", "f_7.txt", "f_8.txt", "f_9.txt", "f_x.txt"]


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(META, "metadata_row bigint, matched_ids string, a string, b string").repartition(4)


@pytest.fixture(scope="module")
def files(spark):
    names = spark.createDataFrame([(f,) for f in FILES], "text_file string")
    return matching.with_file_id(names, "_output.txt")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_repeated_id_in_a_cell_counts_twice(files, meta):
    usable = reconcile.usable_matches(files, meta, LABELS)
    assert rows_of(usable, "text_file", "n_metadata_rows", "match_type", "a") == [
        ("f_1.txt", 1, "single_row", "TRUE"),
        ("f_2.txt", 2, "multi_row_identical", "TRUE"),
        ("f_7.txt", 2, "multi_row_identical", "TRUE"),
        ("g_2.txt", 2, "multi_row_identical", "TRUE"),
    ]


def test_raw_comparison_finds_more_conflicts(files, meta):
    usable = reconcile.usable_matches(files, meta, LABELS, strip_values=False)
    assert rows_of(usable, "file_id") == [("1",), ("7",)]


def test_summary_counts_files_and_ids(files, meta):
    row = matching.match_summary(files, meta).first().asDict()
    assert row == {
        "files_scanned": 8,
        "files_invalid": 1,
        "files_valid": 7,
        "files_matched": 6,
        "files_unmatched": 1,
        "ids_in_metadata": 5,
        "ids_matched": 5,
        "ids_unmatched": 1,
        "ids_with_many_rows": 4,
        "output_rows": 12,
    }


def test_all_files_are_accounted_for(files, meta):
    usable = reconcile.usable_matches(files, meta, LABELS).select("text_file")
    conflicts = reconcile.conflict_details(files, meta, LABELS).where("text_file <> ''").select("text_file")
    report = matching.unmatched_files(files, meta).select("text_file")
    every = usable.unionByName(conflicts).unionByName(report)
    assert sorted(r[0] for r in every.collect()) == sorted(FILES)


def test_agreement_and_rows_per_file(files, meta):
    assert rows_of(reconcile.rows_per_file(files, meta), "row_kind", "n_files") == [("multiple_rows", 5), ("single_row", 1)]
    agreement = reconcile.label_agreement(files, meta, LABELS)
    assert rows_of(agreement, "agreement", "n_files") == [("conflicting", 2), ("identical", 3)]


def test_conflicts_name_the_file_once(files, meta):
    got = rows_of(reconcile.conflict_details(files, meta, LABELS), "file_id", "distinct_label_tuple", "text_file", "n_rows", "a")
    assert got == [
        ("3", 1, "f_3.txt", 3, "FALSE"),
        ("3", 2, "", 3, "TRUE"),
        ("8", 1, "f_8.txt", 2, "TRUE"),
        ("8", 2, "", 2, "true"),
    ]


def test_duplicate_summary_in_input_order(files, meta):
    found = reconcile.duplicate_summary(files, meta, LABELS).orderBy("file_id", "position").collect()
    got = {}
    for r in found:
        counts = (r.row_count, r.unique_prediction_count, r.predictions_same, r.a)
        rows, cells, kept = got.setdefault(r.file_id, ([], [], counts))
        assert r.position == len(rows) and kept == counts
        rows.append(r.metadata_row)
        cells += [r.matched_ids] if r.first_of_cell else []
    assert got == {
        "2": ([3, 4, 3, 4], ["2.0, 3", "2"], (4, 2, False, " TRUE")),
        "3": ([3, 5, 7], ["2.0, 3", "3"], (3, 2, False, " TRUE")),
        "7": ([6, 6], ["7,7"], (2, 1, True, "TRUE")),
        "8": ([9, 10], ["8"], (2, 2, False, "true")),
    }


def test_lists_have_one_shape_at_any_size(spark):
    """One ID with 250,000 rows beside small ones."""
    meta = spark.range(250_300).select(
        F.col("id").alias("metadata_row"),
        F.when(F.col("id") < 250_000, "1").otherwise(F.concat(F.lit("1"), (F.col("id") % 100).cast("string"))).alias("matched_ids"),
        F.lit("TRUE").alias("a"),
        F.lit("x").alias("b"),
    )
    names = spark.createDataFrame([("f_1.txt",), ("f_17.txt",)], "text_file string")
    rows = reconcile.usable_labels(matching.with_file_id(names, ""), meta, LABELS)
    assert "part_no" not in rows.columns
    got = rows.groupBy("file_id", "source_row_count").agg(
        F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position"), F.count_if("first_of_cell"),
        F.count_if(F.col("metadata_row") == F.col("position")),
    )
    assert rows_of(got, *got.columns) == [
        ("1", 250_000, 250_000, 0, 249_999, 250_000, 1, 250_000),
        ("17", 3, 3, 0, 2, 3, 1, 0),
    ]


def test_variants_are_numbered_by_first_appearance(files, meta):
    found = reconcile.label_mismatches(files, meta, LABELS, strip_values=True).where("file_id = '3'")
    assert rows_of(found, "metadata_row", "prediction_variant_index") == [(3, 1), (5, 2), (7, 2)]


def test_statistics_add_up(files, meta):
    row = reconcile.usable_statistics(files, meta, LABELS).first()
    assert row.matched_ids == row.single_match_ids + row.duplicate_same_label_ids + row.duplicate_conflict_ids
    assert row.usable_ids == row.single_match_ids + row.duplicate_same_label_ids
    assert row.input_rows == 12


def test_distribution_and_mode(files, meta):
    usable = reconcile.usable_matches(files, meta, LABELS)
    got = [tuple(r) for r in profiles.label_distribution(usable, LABELS).collect()]
    assert got == [("a", "TRUE", 4, 100.0), ("b", "x", 3, 75.0), ("b", "<blank>", 1, 25.0)]
    assert rows_of(profiles.modal_label(usable, LABELS), "prediction_column", "label_value") == [("a", "TRUE"), ("b", "x")]


def test_published_corpus_counts(spark):
    """987 files: 374 with one row, 154 and 17 with several, 442 without."""
    files = [(f"f_{i}.txt",) for i in range(987)]
    meta, row = [], 2
    for i in range(545):
        n = 1 if i < 374 else 2
        for k in range(n):
            meta.append((row, str(i), "FALSE" if i >= 528 and k else "TRUE"))
            row += 1
    names = matching.with_file_id(spark.createDataFrame(files, "text_file string"), "")
    table = spark.createDataFrame(meta, "metadata_row bigint, matched_ids string, a string")
    summary = matching.match_summary(names, table).first()
    assert (summary.files_scanned, summary.files_matched, summary.files_unmatched) == (987, 545, 442)
    kinds = dict(rows_of(reconcile.rows_per_file(names, table), "row_kind", "n_files"))
    assert kinds == {"single_row": 374, "multiple_rows": 171}
    agreement = dict(rows_of(reconcile.label_agreement(names, table, ["a"]), "agreement", "n_files"))
    assert agreement == {"identical": 154, "conflicting": 17}
    assert reconcile.usable_matches(names, table, ["a"]).count() == 528


@pytest.mark.parametrize("count, share", [(212, 40.15), (283, 53.60), (245, 46.40), (247, 46.78), (268, 50.76)])
def test_published_percentages(spark, count, share):
    rows = spark.range(528).select(F.when(F.col("id") < count, "FALSE").otherwise("other").alias("a"))
    got = profiles.label_distribution(rows, ["a"]).where("label_value = 'FALSE'").first()
    assert (got["count"], got.percent) == (count, share)


def test_guards(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["y"])
    with pytest.raises(ValueError, match="bad: {'x': 1}"):
        require_empty(df, "bad")
    require_empty(df.where("x > 1"), "bad")
    with pytest.raises(ValueError):
        require_rows(df.where("x > 1"))


def test_short_lists_are_numbered_without_range_shuffles(spark, files, meta, monkeypatch):
    """Short lists as long ones, and both at once; files of one name and an ID twice in a cell included."""
    both = files.unionByName(files.where("file_id = '2'"))
    wide = meta.unionByName(meta.withColumn("metadata_row", F.col("metadata_row") + 100))
    calls, spread = [], reconcile.dense_positions
    monkeypatch.setattr(reconcile, "dense_positions", lambda *a: calls.append(a) or spread(*a))
    found = []
    for limit in (100_000, 0, 4):
        monkeypatch.setattr(reconcile, "LIST_ROWS", limit)
        lists = [f(both, wide, LABELS) for f in (reconcile.duplicate_summary, reconcile.usable_labels)]
        found.append([sorted(map(tuple, x.collect()), key=str) for x in lists])
        assert bool(calls) == (limit < 100_000)
    assert found[0] == found[1] == found[2] and all(found[0])

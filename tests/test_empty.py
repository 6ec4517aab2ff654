"""Operators on tables without rows."""

from corpusmill.operators import matching, metrics, quality, reconcile
from corpusmill.plans.prefix import value_stats
from corpusmill.plans.split import stratified_split

PREDICTIONS = "run string, task string, y_true int, p_yes double"
META = "metadata_row bigint, matched_ids string, a string"


def test_no_predictions(spark):
    df = spark.createDataFrame([], PREDICTIONS)
    assert metrics.rank_metrics(df).count() == 0
    assert metrics.threshold_sweep(df, [("0.5", 0.5)]).count() == 0


def test_no_values(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert value_stats(df, ["g"], "x").count() == 0
    assert value_stats(df, [], "x").first()["median"] is None


def test_no_rows_to_split(spark):
    df = spark.createDataFrame([], "task string, label int, file_id string")
    assert stratified_split(df, ["task"], "label", "file_id").count() == 0


def test_no_files_or_metadata(spark):
    files = matching.with_file_id(spark.createDataFrame([], "text_file string"), "")
    meta = spark.createDataFrame([], META)
    row = matching.match_summary(files, meta).first()
    assert set(row.asDict().values()) == {0}
    assert reconcile.usable_matches(files, meta, ["a"]).count() == 0
    assert reconcile.usable_statistics(files, meta, ["a"]).first().input_rows == 0
    assert reconcile.duplicate_summary(files, meta, ["a"]).count() == 0


def test_no_pairs(spark):
    checked = quality.check_pairs(spark.createDataFrame([], "file_id int, src string, out string"))
    assert quality.flag_counts(checked).count() == 0
    assert quality.flagged_preview(checked, 5).count() == 0


def test_null_texts_are_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "file_id int, src string, out string")
    assert quality.check_pairs(df).first().flags == ["empty"]

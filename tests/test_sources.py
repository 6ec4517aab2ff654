"""Readers and writers on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.plans.rownumbers import number_parquet_rows, number_text_rows
from corpusmill.sources.corpus import list_files, read_corpus
from corpusmill.sources.datasets import read_split, read_tasks, write_split, write_tasks
from corpusmill.sources.idlists import read_id_list, write_id_list
from corpusmill.sources.metadata import infer_label_columns, read_csv, read_metadata, select_label_range
from corpusmill.sources.runs import append_summary, read_runs, read_summary


def test_corpus_is_flat_and_case_sensitive(spark, tmp_path):
    (tmp_path / "a 1.txt").write_text("  first\nsecond \n", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("no")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.txt").write_text("no")
    assert [tuple(r) for r in read_corpus(spark, str(tmp_path)).collect()] == [("a 1.txt", "first\nsecond")]
    assert [r[0] for r in list_files(spark, str(tmp_path)).collect()] == ["a 1.txt"]


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_corpus(spark, str(tmp_path / "none"))


def test_csv_encodings_are_chosen_per_file(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿matched_ids,née\n1,“é”\n".encode("utf-8"))
    (tmp_path / "w.csv").write_bytes("matched_ids,née\n02,“é” €\n3.0,\n".encode("cp1252"))
    df = read_metadata(spark, str(tmp_path), ["matched_ids", "née"])
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("02", "“é” €"), ("1", "“é”"), ("3.0", "")]
    assert [t for _, t in df.dtypes] == ["string", "string"]


@pytest.mark.parametrize("multi_line", [False, True])
def test_row_numbers_are_unique_over_mixed_encodings(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_bytes("matched_ids,née\n1,“é”\n\n2,x\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("matched_ids,née\n3,“é” €\n4,\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("\ufeffnée,matched_ids\n\"5, 6\",7\n".encode("utf-8"))
    (tmp_path / "d.csv").write_bytes(b"matched_ids,n\xe9e\n")
    got = read_csv(spark, str(tmp_path), multi_line=multi_line, number_rows=True).orderBy("metadata_row").collect()
    assert [tuple(r) for r in got] == [(2, "1", "“é”"), (3, "2", "x"), (4, "3", "“é” €"), (5, "4", ""), (6, "7", "5, 6")]
    assert read_csv(spark, str(tmp_path / "d.csv"), multi_line=multi_line).columns == ["matched_ids", "née"]
    (tmp_path / "e.csv").write_text("matched_ids,other\n1,2\n")
    with pytest.raises(ValueError, match="different columns"):
        read_csv(spark, str(tmp_path), multi_line=multi_line)


def test_one_verdict_holds_for_all_splits_of_a_file(spark, tmp_path):
    lines = "".join(f"{i},{'é' if i == 1500 else 'x'}{'y' * (i % 40)}\n" for i in range(3000))
    (tmp_path / "w.csv").write_bytes(("i,t\n" + lines).encode("cp1252"))
    (tmp_path / "x.csv").write_bytes(("i,t\n" + lines).encode("utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = read_csv(spark, str(tmp_path), number_rows=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert sorted(r.metadata_row for r in rows) == list(range(2, 6002))
    assert all(int(r.i) == (r.metadata_row - 2) % 3000 for r in rows)
    assert [r.t[0] for r in rows if r.i == "1500"] == ["é", "é"]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('matched_ids,a\n"1, 2","say ""hi""\nthere"\n3,x\n', encoding="utf-8")
    got = read_csv(spark, str(path), multi_line=True, number_rows=True).orderBy("metadata_row").collect()
    assert [tuple(r) for r in got] == [(2, "1, 2", 'say "hi"\nthere'), (3, "3", "x")]


def test_required_columns(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("matched_ids,a\n1,x\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_metadata(spark, str(path), ["matched_ids", "b"])
    df = read_csv(spark, str(path))
    assert infer_label_columns(df) == ["a"]
    with pytest.raises(ValueError):
        infer_label_columns(df.select("matched_ids"))
    with pytest.raises(ValueError):
        infer_label_columns(df.select("a"))


def test_label_range_of_a_table(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("n,Matched_IDs,a,,c\n1,5,x,y,z\n")
    df = select_label_range(read_csv(spark, str(path)), "C:E")
    assert df.columns == ["Matched_IDs", "a", "D", "c"]
    assert tuple(df.first()) == ("5", "x", "y", "z")


def test_row_numbers_over_many_splits_and_files(spark, tmp_path):
    for name, start, stop in (("a", 0, 3000), ("b", 3000, 3500)):
        lines = "".join(f"{i},{'x' * (i % 50)}\n" for i in range(start, stop))
        (tmp_path / f"{name}.csv").write_text("i,t\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        scan = spark.read.csv(str(tmp_path), header=True)
        assert scan.rdd.getNumPartitions() > 8
        got = number_text_rows(scan).select(F.col("i").cast("int"), "metadata_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert sorted(tuple(r) for r in got) == [(i, i + 2) for i in range(3500)]


def test_row_numbers_of_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    got = number_parquet_rows(spark.read.parquet(path), first=0).collect()
    assert sorted(r.metadata_row for r in got) == list(range(1000))
    assert all(r.id == r.metadata_row for r in got)


def test_id_list_round_trip(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\n 12  # short\n\n13\n12\n")
    assert sorted(r[0] for r in read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["12", "13"]
    rows = spark.createDataFrame([("9", ["too_short", "degenerate"], 0.255), ("8", ["empty"], 0.0)], "file_id string, reasons array<string>, out_loop double")
    out = str(tmp_path / "out")
    write_id_list(rows, out)
    text = sorted(r[0] for r in spark.read.text(out).collect())
    assert text == ["8  # empty  loop=0%", "9  # too_short,degenerate  loop=26%"]
    assert sorted(r[0] for r in read_id_list(spark, out).collect()) == ["8", "9"]


def test_json_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"file_id": "1", "text": "t", "label": 1}], indent=2))
    (tmp_path / "l.jsonl").write_text('{"file_id": "2", "input": "i", "label": 0}\n\n')
    array = read_split(spark, str(tmp_path / "a.json"), array=True)
    lines = read_split(spark, str(tmp_path / "l.jsonl"))
    assert array.first().text == "t" and lines.count() == 1 and lines.first().text == "i"
    out = str(tmp_path / "out")
    write_split(lines.select("file_id", "text", F.lit(None).cast("string").alias("gap")), out)
    assert '"gap":null' in spark.read.text(out).first()[0]


def test_task_folders_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", 1), ("a", "test", 2), ("b", "train", 3)], "task string, split string, n int")
    path = str(tmp_path / "tasks")
    write_tasks(rows, path)
    train = read_tasks(spark, path).where("task = 'a' and split = 'train'")
    assert [r.n for r in train.collect()] == [1]
    assert len(train.inputFiles()) == 1 or "PartitionFilters: [isnotnull" in train._jdf.queryExecution().toString()


def test_summary_keeps_its_columns(spark, tmp_path):
    path = str(tmp_path / "summary")
    append_summary(spark.createDataFrame([("m", 0.5)], "model string, f1 double"), path)
    append_summary(spark.createDataFrame([("n", 0.7, 0.6)], "model string, auc double, f1 double"), path)
    append_summary(spark.createDataFrame([("o",)], "model string"), path)
    got = read_summary(spark, path)
    assert got.columns == ["model", "f1"]
    assert sorted((r.model, r.f1) for r in got.collect()) == [("m", "0.5"), ("n", "0.6"), ("o", None)]


def test_runs_without_predictions_are_ignored(spark, tmp_path):
    for run, p in (("r1", 0.5), ("r2", None)):
        folder = tmp_path / run / "t" / "eval"
        folder.mkdir(parents=True)
        (folder / "predictions.jsonl").write_text(
            json.dumps({"file_id": "1", "true": 1, "pred": 0, "p_yes": p, "raw_output": "no"}) + "\n"
        )
        (folder / "metrics.json").write_text(json.dumps({"task": "t", "base_model": "m", "n": 1}, indent=2))
    (tmp_path / "r3" / "t" / "eval").mkdir(parents=True)
    (tmp_path / "r3" / "t" / "eval" / "metrics.json").write_text("{}")
    got = sorted((r.run.split("/")[-3], r.model, r.task, r.y_true, r.p_yes) for r in read_runs(spark, [f"{tmp_path}/*/*/eval"]).collect())
    assert got == [("r1", "m", "t", 1, 0.5), ("r2", "m", "t", 1, None)]

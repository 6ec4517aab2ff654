"""Streams over landing files: each once, restarts included."""

from pyspark.sql import functions as F

from corpusmill.operators.matching import with_file_id
from corpusmill.operators.reconcile import usable_matches
from corpusmill.streaming.match import run_available, stream_match, stream_unmatched
from corpusmill.streaming.pairs import current_pairs, run_pair_checks
from corpusmill.streaming.reconcile import current_agreement, current_counts, current_usable, run_agreement

NAMES = "text_file string"
PAIRS = "file_id string, seq int, src string, out string"


def land(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def test_new_files_are_matched_once(spark, tmp_path):
    meta = spark.createDataFrame([(2, "1,2"), (3, "2")], "metadata_row int, matched_ids string")
    land(spark, [("f_1.txt",), ("f_x.txt",)], NAMES, tmp_path / "in", "a")

    def run():
        names = stream(spark, NAMES, tmp_path / "in")
        run_available(stream_match(names, meta, ""), f"{tmp_path}/out", f"{tmp_path}/cp")
        run_available(stream_unmatched(names, meta, ""), f"{tmp_path}/bad", f"{tmp_path}/cp2")
        matched = sorted((r.text_file, r.metadata_row) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        return matched, sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/bad").collect())

    bad = [("f_x.txt", "", "invalid_filename_id")]
    assert run() == ([("f_1.txt", 2)], bad)
    assert run() == ([("f_1.txt", 2)], bad)
    land(spark, [("f_2.txt",), ("f_9.txt",)], NAMES, tmp_path / "in", "b")
    matched, bad = run()
    assert matched == [("f_1.txt", 2), ("f_2.txt", 2), ("f_2.txt", 3)]
    assert bad == [("f_9.txt", "9", "no_metadata_match"), ("f_x.txt", "", "invalid_filename_id")]


def test_last_pair_wins_across_batches(spark, tmp_path):
    land(spark, [("1", 1, "aaaa", "b"), ("2", 2, "aaaa", "bbbb"), ("1", 3, "aaaa", "bb")], PAIRS, tmp_path / "in", "a")

    def run():
        run_pair_checks(stream(spark, PAIRS, tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/cp")
        rows = current_pairs(spark, f"{tmp_path}/out").select("file_id", "seq", F.array_join("flags", ","))
        return sorted(tuple(r) for r in rows.collect())

    assert run() == [("1", 3, "too_short"), ("2", 2, "")]
    land(spark, [("1", 1, "aaaa", "bbbb")], PAIRS, tmp_path / "in", "b")
    assert run() == [("1", 1, ""), ("2", 2, "")]
    assert run() == [("1", 1, ""), ("2", 2, "")]


def test_one_stored_record_per_id_over_five_restarts(spark, tmp_path):
    folder, latest = tmp_path / "in", {}
    for batch in range(5):
        rows = [(str(i), seq, "aaaa", "b" * ((i + batch + seq) % 5)) for i in range(batch, batch + 6) for seq in (1, 2)]
        land(spark, rows, PAIRS, folder, f"b{batch}")
        run_pair_checks(stream(spark, PAIRS, folder), f"{tmp_path}/out", f"{tmp_path}/cp", changes=f"{tmp_path}/changes")
        latest |= {i: out for i, seq, _, out in rows if seq == 2}
        stored = current_pairs(spark, f"{tmp_path}/out")
        assert {r.file_id: r.len_ratio for r in stored.collect()} == {i: len(out) / 4 for i, out in latest.items()}
        assert stored.count() == len(latest)
        state = spark.read.format("statestore").load(f"{tmp_path}/cp")
        assert state.count() == len(latest)
    changed = spark.read.parquet(f"{tmp_path}/changes")
    assert changed.groupBy("batch_id").count().count() == 5 and changed.where("batch_id = 4").count() == 6
    metadata = "".join(p.read_text() for p in (tmp_path / "cp" / "offsets").iterdir() if not p.name.startswith("."))
    assert "RocksDBStateStoreProvider" in metadata


META = "matched_ids string, label string"


def test_late_rows_withdraw_files_in_any_order(spark, tmp_path):
    files = spark.createDataFrame([(f"f_{i}.txt",) for i in (1, 2, 3, 4, 4)] + [("f_x.txt",)], NAMES)
    batches = [[("1, 2", "A"), ("3", "B")], [("1", "A")], [("2.0", "B"), ("4", "C")], [("3", "B"), ("9", "A")]]
    for name, order in (("forward", batches), ("backward", batches[::-1])):
        folder, seen, standing = tmp_path / name / "in", [], {}
        for k, batch in enumerate(order):
            seen += batch
            land(spark, batch, META, folder, f"b{k}")
            run_agreement(stream(spark, META, folder), ["label"], f"{tmp_path}/{name}/cp", changes=f"{tmp_path}/{name}/changes")
            named = with_file_id(files, "")
            expected = usable_matches(named, spark.createDataFrame(seen, META), ["label"])
            found = current_usable(named, f"{tmp_path}/{name}/cp")
            assert found.columns == expected.columns
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
            for r in spark.read.parquet(f"{tmp_path}/{name}/changes/batch_id={k}").collect():
                standing[r.file_id] = (r.n_metadata_rows, r.usable, r.label)
        state = {r.file_id: (r.n_metadata_rows, r.usable, r._labels.label if r.usable else None) for r in current_agreement(spark, f"{tmp_path}/{name}/cp").collect()}
        assert state == standing and standing["2"] == (2, False, None) and standing["3"] == (2, True, "B")
        assert current_counts(named, f"{tmp_path}/{name}/cp").first()[:] == (2, 3, 2, 1)

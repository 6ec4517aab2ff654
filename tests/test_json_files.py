"""JSON arrays in many tasks, documents of many parts, manifests."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import merging
from corpusmill.sources.datasets import read_manifests
from corpusmill.sources.json_arrays import json_records, read_json_arrays
from corpusmill.sources.sinks import write_documents, write_json_arrays

ODD = ['plain', 'q"uote', "back\\slash", '\\"', "\\\\", "[{]}", "é漢\U0001f600", "", "line\nbreak", '"}, {"a": 1', "\\" * 9]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_do_not_depend_on_the_ranges(spark, tmp_path, range_bytes, indent):
    records = [{"id": i, "t": ODD[i % len(ODD)], "deep": {"l": [1, {"x": ODD[-1 - i % 5]}]}} for i in range(25)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"id": 99, "t": None}]))
    (tmp_path / "none.json").write_text(" [ ] ")
    found = read_json_arrays(spark, str(tmp_path), "id int, t string, deep struct<l: array<string>>", "*.json", range_bytes)
    got = sorted((r.id, r.t) for r in found.collect())
    assert got == [(r["id"], r["t"]) for r in records] + [(99, None)]


JSON = st.recursive(
    st.none() | st.integers() | st.text(st.sampled_from('ab"\\{}[],: é'), max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(st.sampled_from('a"\\{'), max_size=3), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(max_size=3), JSON, max_size=3), max_size=6), st.integers(1, 40))
def test_any_records(spark, tmp_path, records, range_bytes):
    path = tmp_path / "any.json"
    path.write_text(json.dumps(records))
    found = [json.loads(r.value) for r in json_records(spark, str(path), range_bytes=range_bytes).collect()]
    assert sorted(map(json.dumps, found)) == sorted(map(json.dumps, records))


def test_broken_files_fail(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": ')
    (tmp_path / "object.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="ends within a record"):
        json_records(spark, str(tmp_path / "cut.json")).collect()
    with pytest.raises(Exception, match="does not begin with"):
        json_records(spark, str(tmp_path / "object.json")).collect()


def test_a_large_array_is_read_in_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    with path.open("w") as out:
        out.write("[" + ",".join(json.dumps({"id": i, "t": "x" * 90}) for i in range(40_000)) + "]")
    records = json_records(spark, str(path), range_bytes=100_000)
    assert records.select(F.spark_partition_id()).distinct().count() > 20
    found = records.select(F.get_json_object("value", "$.id").cast("int").alias("id"))
    assert found.agg(F.count("*"), F.sum("id")).first()[:] == (40_000, sum(range(40_000)))


def test_arrays_are_written_by_all_tasks_and_read_back(spark, tmp_path):
    rows = [(i, ODD[i % len(ODD)] if i % 4 else None) for i in range(200)]
    path = str(tmp_path / "out")
    write_json_arrays(spark.createDataFrame(rows, "id int, t string").repartition(4), path)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 4 and all(f.name.startswith("part-") for f in files)
    assert sorted((r["id"], r["t"]) for f in files for r in json.loads(f.read_text(encoding="utf-8"))) == rows
    assert sorted(map(tuple, read_json_arrays(spark, path, "id int, t string").collect())) == rows


def test_a_failed_write_shows_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.lit("1")).alias("t"))
    with pytest.raises(Exception, match="broken"):
        write_json_arrays(bad, str(tmp_path / "out"))
    # A task that ends after the abort may leave its own folder, whose name readers pass over.
    assert not list((tmp_path / "out").glob("[!_]*"))


def test_documents_are_joined_in_order(spark, tmp_path):
    rows = [(f"doc{i % 2}.txt", i, f"{i};") for i in range(5000)]
    fragments = spark.createDataFrame(rows, "document string, at int, fragment string").repartition(7)
    write_documents(fragments, str(tmp_path / "out"), ["at"])
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["doc0.txt", "doc1.txt"]
    for k in (0, 1):
        assert (tmp_path / "out" / f"doc{k}.txt").read_text() == "".join(f"{i};" for i in range(k, 5000, 2))


def test_manifest_documents(spark, tmp_path):
    groups = {"g": ["a", "b"], "solo": ["c"]}
    labels = spark.createDataFrame(
        [(str(i), t, i % 2) for i in range(30) for t in "abc" if not (t == "b" and i % 5 == 1)], "file_id string, task string, label int"
    )
    excluded = spark.createDataFrame([("3",), ("3",), ("7",), ("unknown",)], "file_id string")
    merged = merging.merge_labels(labels, groups)
    kept = merging.determined(merging.merge_labels(merging.exclude_ids(labels, excluded), groups))
    rows = kept.withColumn("split", F.when(F.col("file_id") < "2", "test").otherwise("train"))
    ids = merging.manifest_ids(rows, excluded, merged)
    fragments = merging.manifest_fragments(ids, merging.merged_counts(labels, groups, excluded), groups, exclusion_list='li"st.txt')
    write_documents(fragments, str(tmp_path / "m"), ["section_no", "position"])
    made = json.loads((tmp_path / "m" / "g.json").read_text())
    expected = {s: sorted(r.file_id for r in rows.where((F.col("merged_task") == "g") & (F.col("split") == s)).collect()) for s in ("train", "test")}
    assert made["splits"] == expected and made["components"] == ["a", "b"] and made["excluded_file_ids"] == ["3", "7"]
    assert made["n_excluded"] == 2 and made["n_kept"] == sum(map(len, expected.values())) and made["exclusion_list"] == 'li"st.txt'
    back = read_manifests(spark, str(tmp_path / "m"))
    assert back.where("`group` = 'g'").count() == made["n_kept"] + 2 and {r["group"] for r in back.collect()} == {"g", "solo"}

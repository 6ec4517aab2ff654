"""Digest trees, the resume ledger, and tables replaced in place."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import digests, guards
from corpusmill.operators.ledger import Ledger
from corpusmill.operators.pairs import pending
from corpusmill.sources.store import replace_table

SCHEMA = "file_id string, task string, label int"


def rows(spark, change=None, n=3000):
    made = [(str(i) if i % 100 else None, "ab"[i % 2], i % 3 if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(change(made) if change else made, SCHEMA)


def test_equal_tables_are_not_joined(spark):
    left, right = rows(spark), rows(spark, lambda r: r[::-1]).repartition(5)
    diff = guards.label_map_diff(left, right)
    assert diff.collect() == [] and diff.columns == ["file_id", "task", "left_label", "right_label"]
    assert "Join" not in diff._jdf.queryExecution().optimizedPlan().toString()


def test_only_buckets_that_differ_are_joined(spark):
    def change(r):
        return [(i, t, 9 if i == "17" else label) for i, t, label in r if i != "23"] + [("new", "a", 1)]

    diff = guards.label_map_diff(rows(spark).where("file_id is not null"), rows(spark, change).where("file_id is not null"))
    found = {(r.file_id, r.left_label, r.right_label) for r in diff.collect()}
    assert found == {("17", 17 % 3, 9), ("23", 23 % 3, None), ("new", None, 1)}
    trees = [digests.digest_tree(x, ["file_id", "task"]) for x in (rows(spark), rows(spark, change))]
    assert 1 <= len(digests.differing_buckets(*trees)) <= 3
    assert trees[0].where("level = 0").first().n == 3000 and trees[0].count() <= 4369


def test_repeats_nulls_and_number_types_count(spark):
    base = rows(spark)
    tree = digests.digest_tree(base, ["file_id", "task"])
    wide = base.withColumn("label", F.col("label").cast("bigint"))
    assert digests.differing_buckets(tree, digests.digest_tree(wide, ["file_id", "task"])) == []
    twice = digests.digest_tree(base.union(base.limit(1)), ["file_id", "task"])
    assert len(digests.differing_buckets(tree, twice)) == 1
    moved = base.withColumn("label", F.coalesce("label", F.lit(0)))
    assert digests.differing_buckets(tree, digests.digest_tree(moved, ["file_id", "task"]))
    empty = digests.digest_tree(base.limit(0), ["file_id", "task"])
    assert digests.differing_buckets(empty, empty) == []


def test_ledger_over_several_runs(spark, tmp_path):
    texts = spark.range(4000).select(F.col("id").cast("string").alias("file_id"), F.lit("text").alias("text"))
    texts = texts.union(spark.createDataFrame([(None, "no id")], "file_id string, text string"))
    path = str(tmp_path / "ledger")
    ledger = Ledger.create(spark, path, buckets=4, bits=1 << 12)
    assert ledger.pending(texts).count() == 4001
    done = texts.where("cast(file_id as int) % 5 < 2")
    ledger.add(done.where("cast(file_id as int) < 2000"))
    again = Ledger.open(spark, path)
    assert again == ledger
    again.add(done)
    again.add(done)
    found = sorted(r.file_id or "" for r in again.pending(texts).select("file_id").collect())
    assert found == sorted(r.file_id or "" for r in pending(texts, done).select("file_id").collect())
    ids, name = again.ids()
    assert ids.count() == 1600
    asked = spark.range(4000).select(F.col("id").cast("string").alias("file_id"))
    plan = asked.hint("merge").join(ids, "file_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    ledger_side = plan.split("Range (0, 4000")[1]
    assert "SelectedBucketsCount: 4 out of 4" in ledger_side and "Exchange" not in ledger_side
    spark.sql(f"DROP TABLE {name}")


def test_the_filter_is_sure_of_most_strangers(spark, tmp_path):
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), id_type="bigint", bits=1 << 16)
    ledger.add(spark.range(2000).withColumnRenamed("id", "file_id"))
    texts = spark.range(2000, 12_000).withColumnRenamed("id", "file_id")
    assert ledger.unsure(texts).where("_unsure").count() < 100
    known = spark.range(2000).withColumnRenamed("id", "file_id")
    assert ledger.unsure(known).where("not _unsure").count() == 0


def test_a_table_is_replaced_by_what_reads_it(spark, tmp_path):
    path = str(tmp_path / "store")
    replace_table(spark.range(3), path)
    kept = replace_table(spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert sorted(r.id for r in spark.read.parquet(kept).collect()) == [0, 1, 2]
    failing = spark.read.parquet(path).select(F.raise_error(F.lit("broken")).cast("int").alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace_table(failing, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]

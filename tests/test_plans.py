"""Distributed totals, quantiles, splits and lists against plain forms."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.plans import split as split_plan
from corpusmill.plans.materialize import small_lookup
from corpusmill.plans.prefix import running_totals, value_stats
from corpusmill.plans.split import seeded_hash, stratified_split
from corpusmill.plans.spread import spread


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group."""
    rng = random.Random(1)
    rows = [("hot" if i % 2 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(4000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, pos int, x bigint").repartition(6)


def test_running_totals_equal_a_window(spark, skewed):
    w = Window.partitionBy("g").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.withColumn("x_before", F.coalesce(F.sum("x").over(w), F.lit(0)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = running_totals(skewed, ["g"], [F.desc("pos")], ["x"])
        assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_value_stats_equal_python(skewed):
    groups = defaultdict(list)
    for r in skewed.collect():
        groups[r.g].append(r.x)
    for r in value_stats(skewed, ["g"], "x").collect():
        values = groups.pop(r.g)
        assert (r.n, r["median"], r.min, r.max) == (len(values), statistics.median(values), min(values), max(values))
    assert not groups
    whole = value_stats(skewed, [], "x").first()
    assert whole["median"] == statistics.median([r.x for r in skewed.collect()])


@pytest.mark.parametrize("digits", [1, 4])
def test_split_equals_a_window(skewed, monkeypatch, digits):
    monkeypatch.setattr(split_plan, "BUCKET_DIGITS", digits)
    rows = skewed.withColumn("label", (F.col("x") > 6).cast("int"))
    cell = Window.partitionBy("g", "label")
    rank = F.row_number().over(cell.orderBy(seeded_hash("pos", 42)))
    quota = F.bround(F.count("*").over(cell) * 0.2)
    plain = rows.withColumn("split", F.when(rank <= quota, "test").otherwise("train"))
    ours = stratified_split(rows, ["g"], "label", "pos")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_split_depends_on_seed_and_id_only(skewed):
    rows = skewed.withColumn("label", (F.col("x") > 6).cast("int"))

    def sides(df, seed):
        return {r.pos: r.split for r in stratified_split(df, ["g"], "label", "pos", seed=seed).collect()}

    base = sides(rows, 42)
    assert base == sides(rows.repartition(3).orderBy("x"), 42)
    assert base != sides(rows, 13)


def test_split_takes_no_test_row_from_tiny_classes(spark):
    rows = spark.createDataFrame([("t", 1, "a"), ("t", 0, "b"), ("t", 0, "c")], "task string, label int, id string")
    assert {r.split for r in stratified_split(rows, ["task"], "label", "id").collect()} == {"train"}


def test_lookup_is_broadcast_only_when_small(spark):
    rows = spark.range(100)
    assert "ResolvedHint" in small_lookup(rows, 100)._jdf.queryExecution().analyzed().toString()
    assert small_lookup(rows, 99) is rows


def test_spread_leaves_many_splits_alone(spark):
    many = spark.range(0, 1000, 1, 64)
    assert spread(many, "id") is many
    assert spread(spark.range(0, 1000, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_counts_of_batches_give_the_cuts_of_all_rows(spark):
    from corpusmill.plans.split import cuts_of_counts, hash_counts, merge_hash_counts, split_cuts

    rows = spark.range(4000).selectExpr("'t' as task", "cast(id % 3 = 0 as int) as label", "cast(id % 1700 as string) as file_id")
    batches = [rows.where(f"pmod(xxhash64(file_id, label), 4) = {k}") for k in range(4)]
    counts = hash_counts(batches[0], ["task"], "label", "file_id", 42)
    for batch in batches[1:]:
        counts = merge_hash_counts(counts, hash_counts(batch, ["task"], "label", "file_id", 42))
    found = sorted(map(tuple, cuts_of_counts(counts, ["task"], "label", 0.2).collect()))
    assert found == sorted(map(tuple, split_cuts(rows, ["task"], "label", "file_id", 0.2, 42).collect())) and len(found) == 2


def test_a_hot_id_in_the_edge_prefix_is_one_line(spark):
    import hashlib

    from pyspark.sql import functions as F

    from corpusmill.plans.split import stratified_split

    ids = sorted(range(300), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    # A third of the rows belong to the ID at which the quota ends.
    hot = ids[30]
    rows = [("t", 1, str(i)) for i in ids] + [("t", 1, str(hot))] * 150
    df = spark.createDataFrame(rows, "task string, label int, file_id string").repartition(8)
    split = stratified_split(df, ["task"], "label", "file_id", 0.2, 42)
    test = {r.file_id for r in split.where("split = 'test'").collect()}
    # 90 of 450 rows: the 30 IDs before the hot one, and all of its rows.
    assert test == {str(i) for i in ids[:31]}
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert split.agg(F.count("*")).first()[0] == 450 and "Window" not in plan.split("BroadcastExchange")[0]

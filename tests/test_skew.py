"""Tables of several files in which one key holds a third of all rows."""

import pytest
from compare import TABLES, connect, differences
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract

SOURCE = "/root/testdata/sf0.001"
NAMES = (
    "match_files match_summary usable_matches conflict_details duplicate_summary usable_labels label_mismatches "
    "label_distribution stratified_split split_overlap merged_labels split_manifest text_conflicts unique_texts "
    "dedupe_policies upsert_pairs pair_quality ratio_stats mean_pool render_chat rank_metrics threshold_sweep "
    "task_records stream_match stream_pair_quality"
).split()


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The test tables with a hot order, user, source, conversation and vector label."""
    folder = tmp_path_factory.mktemp("skewed")

    def hot(column, key, value):
        return F.when(F.abs(F.xxhash64(*key)) % 3 == 0, F.lit(value)).otherwise(F.col(column))

    changes = {
        "lineitem": {"l_orderkey": hot("l_orderkey", ["l_partkey", "l_suppkey", "l_extendedprice"], 7)},
        "events": {"user_id": hot("user_id", ["event_id"], 3), "ts": F.date_trunc("month", "ts")},
        "documents": {"source": hot("source", ["doc_id"], "src0")},
        "conversations": {"conv_id": hot("conv_id", ["conv_id", "turn"], 0)},
        "embeddings": {"label": hot("label", ["vec_id"], 1)},
    }
    for name in TABLES:
        df = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        df = df.withColumns({c: x.cast(df.schema[c].dataType) for c, x in changes.get(name, {}).items()})
        if name == "conversations":
            df = df.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.md5("text"))).cast("bigint"))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_results_hold_under_skew(spark, skewed, name):
    for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(setting, "-1")
    try:
        df = contract.queries()[name](spark, skewed)
        assert differences(df, connect(skewed), contract.oracle_sql()[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")

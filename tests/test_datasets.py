"""Task datasets, merging, guards and text pairs on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat, datasets, guards, merging, models, pairs, quality

GROUPS = {"g": ["x", "y", "z"]}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    "labels, expected",
    [
        ({"x": 1}, 1),
        ({"x": 0, "y": 0, "z": 0}, 0),
        ({"x": 0, "y": 0}, None),
        ({"x": 0, "y": 1}, 1),
        ({"other": 1}, "absent"),
    ],
)
def test_three_valued_or(spark, labels, expected):
    df = spark.createDataFrame([("f", t, v) for t, v in labels.items()], "file_id string, task string, label int")
    merged = merging.merge_labels(df, GROUPS).collect()
    assert (merged[0].label if merged else "absent") == expected


def test_a_task_may_be_in_two_groups(spark):
    df = spark.createDataFrame([("f", "x", 0)], "file_id string, task string, label int")
    merged = merging.merge_labels(df, {"g": ["x"], "h": ["x", "y"]})
    assert rows_of(merged, "merged_task", "label") == [("g", 0), ("h", None)]


def test_last_label_wins_and_exclusion_counts(spark):
    df = spark.createDataFrame(
        [("f", "x", 1, 0), ("f", "x", 2, 1), ("g", "x", 3, 0), ("h", "x", 4, 1)],
        "file_id string, task string, seq int, label int",
    )
    last = merging.last_labels(df)
    assert rows_of(last, "file_id", "label") == [("f", 1), ("g", 0), ("h", 1)]
    out = spark.createDataFrame([("h",), ("unknown",)], "file_id string")
    row = merging.merged_counts(last, {"g": ["x", "y"]}, out).first()
    assert (row.n_kept, row.n_dropped_undetermined, row.n_excluded) == (1, 1, 1)
    assert rows_of(merging.exclude_ids(last, out), "file_id") == [("f",), ("g",)]


def test_manifest_has_one_shape_at_any_size(spark):
    rows = spark.range(250_000).select(
        F.lit("g").alias("merged_task"), F.col("id").cast("string").alias("file_id"),
        F.when(F.col("id") % 50 == 0, "test").otherwise("train").alias("split"),
    )
    manifest = merging.split_manifest(rows)
    got = manifest.groupBy("split", "n_ids").agg(F.count("*"), F.max("position"), F.count_distinct("position", "file_id"))
    assert rows_of(got, *got.columns) == [("test", 5_000, 5_000, 4_999, 5_000), ("train", 245_000, 245_000, 244_999, 245_000)]
    ids = [r.file_id for r in manifest.where("split = 'test'").orderBy("position").collect()]
    assert ids == sorted(str(i) for i in range(0, 250_000, 50))


def test_binary_rows_and_instructions(spark):
    df = spark.createDataFrame([("1", "f", "hi", " true", "no_response")], "file_id string, text_file string, text string, `A b` string, c string")
    records = datasets.binary_label_rows(df, ["A b", "c"], ["file_id", "text_file", "text"])
    assert rows_of(records, "task", "label", "label_text") == [("a_b", 1, "TRUE")]
    made = datasets.to_instruction(records, {"a_b": "Is it?"}).first()
    assert (made.instruction, made.input, made.output) == ("Is it?\nAnswer with exactly one word: Yes or No.", "hi", "Yes")


def test_weights(spark):
    df = spark.createDataFrame([("t", 0)] * 10 + [("u", 0)] * 9 + [("u", 1)], "task string, label int")
    weights = {r.task: (r.weight_neg, r.weight_pos) for r in datasets.class_weights(df).collect()}
    assert weights == {"t": (0.55, 5.5), "u": (10 / 18, 5.0)}
    pos = {r.task: r.pos_weight for r in datasets.positive_weight(df, alpha=1.0, cap=4.0).collect()}
    assert pos == {"t": 1.0, "u": 4.0}
    soft = {r.task: r.pos_weight for r in datasets.positive_weight(df, alpha=0.5, cap=4.0).collect()}
    assert soft["u"] == 3.0


def test_leaks(spark):
    rows = spark.createDataFrame(
        [("1", "a", "train"), ("1", "b", "test"), ("2", "a", "train"), ("2", "a", "test"), ("3", "a", "test"), ("3", "b", "test")],
        "file_id string, task string, split string",
    )
    assert rows_of(guards.cross_task_leak(rows), "file_id", "train_tasks", "test_tasks") == [("1", "a", "b")]
    assert rows_of(guards.split_overlap(rows), "task", "file_id") == [("a", "2")]


def test_text_and_label_conflicts(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "x"), ("2", "y"), ("3", None), ("3", "")], "file_id string, text string")
    assert rows_of(guards.text_conflicts(rows), "file_id", "n_texts") == [("2", 2)]
    a = spark.createDataFrame([("1", "t", 1), ("2", "t", 0), ("3", "t", None)], "file_id string, task string, label int")
    b = spark.createDataFrame([("1", "t", 0), ("3", "t", None), ("4", "t", 1)], "file_id string, task string, label int")
    assert sorted(map(str, rows_of(guards.label_map_diff(a, b), "file_id", "left_label", "right_label"))) == [
        "('1', 1, 0)", "('2', 0, None)", "('4', None, 1)",
    ]


def test_summary_violations(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "a"), ("n", "a"), ("n", "b")], "model string, task string")
    got = rows_of(guards.summary_violations(df, ["a", "b"]), "model", "task", "problem")
    assert got == [("m", "a", "duplicate"), ("m", "b", "missing")]


def test_pending_and_upsert(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "file_id string, seq int, out string")
    redone = spark.createDataFrame([("b", 9, "Y"), ("c", 10, "C")], "file_id string, seq int, out string")
    got = rows_of(pairs.upsert_pairs(stored, redone), "seq", "file_id", "out", "appended", "replaced")
    assert got == [(1, "a", "x", False, False), (2, "b", "Y", False, True), (10, "c", "C", True, True)]
    texts = spark.createDataFrame([("c", "t"), ("a", "t"), ("d", "t")], "file_id string, text string")
    assert rows_of(pairs.pending(texts, stored), "file_id") == [("c",), ("d",)]
    assert rows_of(pairs.pending(texts, stored, limit=1), "file_id") == [("c",)]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 3, "y")], "k string, seq int, v string")
    assert pairs.keep_first(df, ["k"], "seq").first().v == "x"
    assert pairs.keep_last(df, ["k"], "seq").first().v == "y"


def test_unique_texts_prefer_task_then_train(spark):
    rows = spark.createDataFrame(
        [("1", "b", "train", "tb"), ("1", "a", "test", "te"), ("1", "a", "train", "tr")],
        "file_id string, task string, split string, text string",
    )
    assert rows_of(pairs.unique_texts(rows), "file_id", "text") == [("1", "tr")]


def test_swap_changes_only_the_text(spark):
    rows = spark.createDataFrame([("1", "old", 1)], "file_id string, text string, label int")
    other = spark.createDataFrame([("1", "new")], "file_id string, out string")
    assert pairs.swap_text(rows, other).columns == rows.columns
    assert tuple(pairs.swap_text(rows, other).first()) == ("1", "new", 1)


def test_checked_pairs_and_reports(spark):
    df = spark.createDataFrame([(1, "a" * 8, "b" * 1), (2, "a" * 8, "b" * 8), (3, "a" * 8, "b" * 24)], "file_id int, src string, out string")
    checked = quality.check_pairs(df)
    assert rows_of(checked, "file_id", "flags", "len_ratio") == [(1, ["too_short"], 0.125), (2, [], 1.0), (3, ["too_long"], 3.0)]
    assert rows_of(quality.flag_counts(checked), "kind", "n") == [("(clean)", 1), ("(flagged)", 2), ("too_long", 1), ("too_short", 1)]
    stats = quality.ratio_stats(checked).first()
    assert (stats.n, stats["median"], stats.min, stats.max) == (3, 1.0, 0.125, 3.0)
    labels = spark.createDataFrame([(1, "t", 1), (2, "t", 1), (3, "t", 0)], "file_id int, task string, label int")
    assert rows_of(quality.flag_rate_by_label(checked, labels), "label", "n", "flag_rate") == [(0, 1, 1.0), (1, 2, 0.5)]
    assert [r.file_id for r in quality.flagged_preview(checked, 1, 3).collect()] == [1]
    assert rows_of(quality.damaged(checked), "file_id") == [(1,)]


def test_pairs_are_measured_once(spark):
    df = spark.createDataFrame([(1, "a", "b")], "file_id int, src string, out string")
    plan = quality.damaged(quality.check_pairs(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 2


def test_chat_layout(spark):
    turns = [("c", 0, "system", "S"), ("c", 1, "user", "U"), ("c", 2, "assistant", "A"), ("c", 3, "user", "V"), ("d", 5, "user", "W")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    def prompts(df):
        found = chat.render_chat(df, "</s>", True).orderBy("conv_id", "position").collect()
        texts = {}
        for r in found:
            assert r.position == len(texts.setdefault(r.conv_id, []))
            texts[r.conv_id].append(r.prompt)
        assert all(r.n_turns == len(texts[r.conv_id]) for r in found)
        return {k: "".join(v) for k, v in texts.items()}

    assert prompts(df) == {"c": "<User>: S\n\nU <Assistant>: A</s>V <Assistant>:", "d": "<User>: W <Assistant>:"}
    sparse = [("t", 1_700_000_000, "user", "U"), ("t", 1_700_090_000, "assistant", None), ("t", 1_900_000_000, "user", None)]
    assert prompts(spark.createDataFrame(sparse, df.schema)) == {"t": "<User>: U <Assistant>: </s> <Assistant>:"}
    one = spark.createDataFrame([("Q", "T")], "q string, t string")
    prompt = one.select(chat.render_messages(chat.to_messages("q", "t", "S"), "</s>")).first()[0]
    assert prompt == "<User>: S\n\nQ\n\nT"


def test_chunk_rows_and_pooling(spark):
    df = spark.createDataFrame([("a", "1 2 3 4 5"), ("b", "")], "file_id string, text string")
    got = rows_of(models.chunk_rows(df, 4, 9), "file_id", "chunk_no", "tokens")
    assert got == [("a", 0, ["1", "2"]), ("a", 1, ["3", "4"]), ("a", 2, ["5"]), ("b", 0, [])]
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.5, 0.5])], "id string, v array<float>")
    assert rows_of(models.mean_pool(vectors, "id", "v"), "id", "v") == [("a", [2.0, 4.0]), ("b", [0.5, 0.5])]


def test_scorer_sees_whole_batches(spark):
    df = spark.range(0, 10, 1, 1).select("id", F.col("id").cast("string").alias("text"))

    def make():
        return lambda texts: [len(texts)] * len(texts)

    assert sorted(r.p_yes for r in models.batch_score(df, make, batch_size=4).collect()) == [2.0] * 2 + [4.0] * 8


def test_retry_stops_at_the_limit_and_keeps_flags(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "b" * 10), (3, "c" * 10)], "file_id int, src string")

    def make():
        def transform(texts, attempt):
            return [t if t[0] == "a" or (t[0] == "b" and attempt == 1) else t[:2] for t in texts]

        return transform

    got = rows_of(models.transform_with_retry(df, make, 1), "file_id", "attempt", "flags")
    assert got == [(1, 0, []), (2, 1, []), (3, 1, ["too_short"])]


def test_baseline_learns_a_word(spark):
    rows = spark.createDataFrame([(f"{'good' if i % 2 else 'bad'} w{i % 5}", float(i % 2)) for i in range(60)], "text string, label double")
    model = models.fit_baseline(rows, 1 << 10)
    scored = models.baseline_scores(model, rows).collect()
    assert all((r.p_yes > 0.5) == (r.label == 1.0) for r in scored)


def test_swap_needs_every_counterpart(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "file_id string, text string")
    other = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "file_id string, out string, seq int")
    with pytest.raises(Exception, match="no counterpart text for 2"):
        pairs.swap_text(rows, other).collect()
    assert rows_of(pairs.swap_text(rows.where("file_id = '1'"), other, order="seq"), "file_id", "text") == [("1", "new")]


def test_redone_twice_counts_once(spark):
    kind = "file_id string, seq int, out string"
    stored = spark.createDataFrame([("1", 1, "a"), ("1", 5, "b"), ("2", 2, "c")], kind)
    redone = spark.createDataFrame([("1", 7, "x"), ("1", 8, "y"), ("3", 9, "z")], kind)
    assert rows_of(pairs.upsert_pairs(stored, redone), "file_id", "seq", "out") == [("1", 1, "y"), ("2", 2, "c"), ("3", 9, "z")]

"""Stored flags as a fallback, and sketches of ratios."""

import random

from corpusmill.operators import quality


def test_texts_decide_and_stored_flags_stand_in(spark):
    rows = [
        ("1", "aaaa", "aaaa", ["pers(1->0)"]),
        ("2", None, "aaaa", ["pers(1->0)", "arabic_residue(0.20)", "too_long(3.00)"]),
        ("3", "aaaa", None, None),
        ("4", "a" * 100, "a", []),
        ("5", None, None, ["personal", "pers"]),
    ]
    records = spark.createDataFrame(rows, "file_id string, src string, out string, flags array<string>")
    found = {r.file_id: r.flags for r in quality.current_flags(records).collect()}
    assert found["1"] == [] and found["3"] == [] and [f.split("(")[0] for f in found["4"]] == ["too_short"]
    assert found["2"] == ["placeholder(1->0)", "script_residue(0.20)", "too_long(3.00)"]
    assert found["5"] == ["personal", "placeholder"]
    assert [r.file_id for r in quality.damaged(quality.current_flags(records)).orderBy("file_id").collect()] == ["2", "4"]


def test_merged_sketches_stay_within_the_bound(spark):
    draw = random.Random(4)
    values = [draw.lognormvariate(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 10, v) for i, v in enumerate(values)], "batch int, len_ratio double")
    parts = quality.ratio_sketches(df, ["batch"])
    merged, whole = quality.merge_sketches(parts), quality.ratio_sketches(df)
    ordered = sorted(values)
    for sketch in (merged, whole):
        row = sketch.select("n", "min", "max", *[quality.sketched_quantile(q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)]).first()
        assert (row.n, row.min, row.max) == (20_000, ordered[0], ordered[-1])
        for q in (0.05, 0.5, 0.95):
            rank = sum(v <= row[f"q{int(q * 100)}"] for v in values) / 20_000
            assert abs(rank - q) < 0.01
    assert max(len(r.sketch) for r in parts.collect()) < 20_000


def test_loops_of_sources_are_measured_for_looping_outputs_only(spark):
    """No source is split into words unless its output loops or the column is asked for."""
    loop = "a " * 100
    rows = [(i, "word " + " ".join(map(str, range(100))), loop if i == 0 else f"x {i} " + " ".join(map(str, range(100)))) for i in range(20)]
    pairs = spark.createDataFrame(rows, "file_id int, src string, out string").coalesce(1)
    checked = quality.check_pairs(pairs)
    plan = checked.select("file_id", "flags")._jdf.queryExecution().optimizedPlan().toString()
    generate = plan.split("Generate inline")[1]
    assert "lower(out" in generate and "lower(src" not in generate
    got = {r.file_id: r for r in checked.collect()}
    assert "degenerate" in got[0].flags and got[0].src_loop == 0.0 and got[0].out_loop == 1.0
    assert not any("degenerate" in got[i].flags for i in range(1, 20))
    # A source that loops as much as its output is no loss.
    same = quality.check_pairs(spark.createDataFrame([(1, loop, loop)], "file_id int, src string, out string")).first()
    assert same.flags == [] and same.src_loop == 1.0

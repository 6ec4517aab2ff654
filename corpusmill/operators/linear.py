"""Linear text classifiers of all tasks at once, fitted by joins and sums.

The training table holds one row per (task, file, word) with its TF-IDF value, bucketed by
file. A step joins it with the weights, a table of (task, word), sums margins per file and
gradients per word, and so moves the weights of every task together. Files stay in their
buckets: a step shuffles only partial sums, one per task, word and bucket at most.

Where the weights are too many to broadcast, files lie in blocks of about ``BLOCK_CELLS``
counts, each with a numbering of its own words. A step sends a block the weights of these
words and gets one gradient of each; the counts themselves stay where they are.

Steps are Nesterov's on the class-weighted logistic loss. The same pass measures the weights
before the step on the held-out rows; each task keeps the weights of its best step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.numbers import ratio
from corpusmill.plans.materialize import BROADCAST_ROWS, broadcast_if_small, materialize, scratch_path

# The word of the intercept: no word of a text is empty.
INTERCEPT = ""

# Counts of words in texts that one task holds at once, and those it works on at once.
BLOCK_CELLS = 1 << 22
CHUNK_CELLS = 1 << 18


@dataclass(frozen=True)
class LinearSettings:
    """``rate`` 2 is the reciprocal of the steepest curvature: rows have length 1, and an intercept."""

    steps: int = 30
    rate: float = 2.0
    decay: float = 1e-4
    min_files: int = 2
    measure: str = "f1_pos"


def word_weights(train: DataFrame, counts: DataFrame, id_col: str = "file_id", min_files: int = 2) -> DataFrame:
    """(task, word, idf) of the words in at least ``min_files`` train texts of a task."""
    sizes = train.groupBy("task").agg(F.count("*").alias("_files"))
    seen = train.select("task", id_col).join(counts, id_col).groupBy("task", "word").agg(F.count("*").alias("_seen"))
    idf = F.log((F.col("_files") + 1.0) / (F.col("_seen") + 1.0)) + 1.0
    # One row per task of a registry.
    return seen.where(F.col("_seen") >= min_files).join(F.broadcast(sizes), "task").select("task", "word", idf.alias("idf"))


def feature_rows(rows: DataFrame, counts: DataFrame, vocabulary: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One row per kept column, word and unit-length TF-IDF value ``x``, and one for the intercept.

    ``rows`` are unique in task and ID. Words outside the vocabulary count for nothing; a
    text without known words has its intercept only.
    """
    kept = rows.columns
    known = rows.join(counts, id_col).join(broadcast_if_small(vocabulary), ["task", "word"])
    cells = known.select(*kept, "word", (F.col("n") * F.col("idf")).alias("_raw"))
    of_file = Window.partitionBy(id_col, "task")
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(of_file))
    scaled = cells.repartition(id_col).select(*kept, "word", (F.col("_raw") / length).alias("x"))
    return scaled.unionByName(rows.select(*kept, F.lit(INTERCEPT).alias("word"), F.lit(1.0).alias("x")))


def _shared_rows(splits: DataFrame, weights: DataFrame, id_col: str) -> DataFrame:
    """(task, ID, label) with each train row's share of its task's class weights; NULL for held-out rows."""
    weight = F.when(F.col("label") == 1, F.col("weight_pos")).otherwise(F.col("weight_neg"))
    total = F.col("n_neg") * F.col("weight_neg") + F.col("n_pos") * F.col("weight_pos")
    share = F.when(F.col("split") == "train", weight / total)
    return splits.join(F.broadcast(weights), "task").select("task", id_col, F.col("label").cast("int").alias("label"), share.alias("share"))


def _training_table(splits: DataFrame, counts: DataFrame, vocabulary: DataFrame, weights: DataFrame, id_col: str) -> DataFrame:
    """Feature rows of ``_shared_rows``."""
    return feature_rows(_shared_rows(splits, weights, id_col), counts, vocabulary, id_col)


def _bucketed(df: DataFrame, key: str, order: Sequence[str] = ("task",), n: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, bucketed by ``key``, and the name to drop it by."""
    spark = df.sparkSession
    n, name = n or int(spark.conf.get("spark.sql.shuffle.partitions")), f"linear_{uuid.uuid4().hex}"
    spread = df.repartition(n, key)
    spread.write.bucketBy(n, key).sortBy(key, *order).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name), name


def _pass(features: DataFrame, state: DataFrame, id_col: str) -> DataFrame:
    """Per task and word the gradient at ``ahead``; on intercepts the held-out counts at ``weight``."""
    of_file = Window.partitionBy(id_col, "task")
    weights = state.select("task", "word", "weight", "ahead")
    joined = features.join(F.broadcast(weights), ["task", "word"])
    rows = joined.select(
        "task",
        "word",
        "label",
        "share",
        "x",
        F.sum(F.col("x") * F.col("ahead")).over(of_file).alias("_margin"),
        F.sum(F.col("x") * F.col("weight")).over(of_file).alias("_score"),
    )
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin"))) - F.col("label")
    held_out = (F.col("word") == INTERCEPT) & F.col("share").isNull()

    def cases(label: int, said: Column) -> Column:
        return F.count_if(held_out & (F.col("label") == label) & said)

    yes = F.col("_score") >= 0
    return rows.groupBy("task", "word").agg(
        F.coalesce(F.sum(F.col("share") * miss * F.col("x")), F.lit(0.0)).alias("_gradient"),
        cases(0, ~yes).alias("tn"),
        cases(0, yes).alias("fp"),
        cases(1, ~yes).alias("fn"),
        cases(1, yes).alias("tp"),
    )


MEASURES = {
    "f1_pos": lambda: ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "macro_f1": lambda: (
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
        + ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))
    )
    / 2,
    "accuracy": lambda: ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
}


@dataclass(frozen=True)
class LinearFit:
    """``weights``: (task, word, idf, weight, step); ``history``: (task, step, tn, fp, fn, tp, measure)."""

    weights: DataFrame
    history: DataFrame


def fit_linear(
    counts: DataFrame,
    splits: DataFrame,
    weights: DataFrame,
    settings: LinearSettings = LinearSettings(),
    id_col: str = "file_id",
) -> LinearFit:
    """Fit every task of ``splits`` (task, ID, label, split) in the same passes.

    ``counts`` comes from ``word_counts``, ``weights`` from ``class_weights`` of the train
    rows. Of steps with the same best measure the first counts. A task without held-out rows
    measures 0 throughout and keeps its first step; one without train rows is left out.
    """
    splits = materialize(splits.select("task", id_col, "label", "split"))
    vocabulary = materialize(word_weights(splits.where("split = 'train'"), counts, id_col, settings.min_files))
    # All states have the rows of the vocabulary, and one per task of a registry.
    if vocabulary.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _fit_blocks(counts, _shared_rows(splits, weights, id_col), vocabulary, weights, settings, id_col)
    features, name = _bucketed(_training_table(splits, counts, vocabulary, weights, id_col), id_col)
    intercepts = weights.select("task", F.lit(INTERCEPT).alias("word"), F.lit(None).cast("double").alias("idf"))
    state = vocabulary.unionByName(intercepts).withColumns({"weight": F.lit(0.0), "ahead": F.lit(0.0)})
    state = materialize(state)
    states, measured = [], []
    for step in range(1, settings.steps + 2):
        before = state.select("task", "word", "idf", "weight", "ahead")
        moved = before.join(_pass(features, before, id_col), ["task", "word"])
        shrink = F.when(F.col("word") == INTERCEPT, 0.0).otherwise(settings.decay)
        after = F.col("ahead") - settings.rate * (F.col("_gradient") + shrink * F.col("ahead"))
        onward = after + (step - 1) / (step + 2) * (after - F.col("weight"))
        state = materialize(
            moved.select(
                "task", "word", "idf", after.alias("weight"), onward.alias("ahead"), "tn", "fp", "fn", "tp"
            )
        )
        # A pass counts for the weights it starts from: those of step 0 are none.
        if step > 1:
            measured.append(state.where(F.col("word") == INTERCEPT).select("task", F.lit(step - 1).alias("step"), "tn", "fp", "fn", "tp"))
        states.append(state.select("task", "word", "idf", "weight", F.lit(step).alias("step")))
    features.sparkSession.sql(f"DROP TABLE {name}")
    history, best = _measured(measured, settings)
    # One row per task; the other steps' weights are dropped as they are read.
    kept = reduce(DataFrame.unionByName, states[:-1]).join(F.broadcast(best), ["task", "step"])
    return LinearFit(kept.select("task", "word", "idf", "weight", "step"), history)


def _measured(counts: Sequence[DataFrame], settings: LinearSettings) -> tuple[DataFrame, DataFrame]:
    """The history of all steps, and the best step of each task."""
    history = materialize(reduce(DataFrame.unionByName, counts).withColumn(settings.measure, MEASURES[settings.measure]()))
    return history, history.groupBy("task").agg(F.min_by("step", F.struct(-F.col(settings.measure), "step")).alias("step"))


# Word numbers of the intercept and of the held-out counts, which go the way of gradients.
START = -1
CASES = {"tn": -2, "fp": -3, "fn": -4, "tp": -5}


def _block_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` block numbers that fall into a partition each when dealt out by hash to ``n``."""
    dealt = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    return [r.id for r in dealt.orderBy("at").collect()]


def _block_table(counts: DataFrame, rows: DataFrame, words: DataFrame, tasks: Sequence[str], id_col: str) -> tuple[DataFrame, str]:
    """Per block one row with its words and their ``idf``, and rows with the word counts of some files each.

    Files go to blocks by their hash; ``word`` in the counts is the place of a word in its block.
    """
    spark, ks = counts.sparkSession, range(len(tasks))
    cells = counts.join(words, "word").select(id_col, F.col("n").cast("int").alias("n"), "word_no", *[f"idf{k}" for k in ks])
    marks = rows.groupBy(id_col).agg(
        *[F.max(F.when(F.col("task") == t, F.col(c))).cast("double").alias(f"{c}{k}") for k, t in enumerate(tasks) for c in ("label", "share")]
    )
    n = max(spark.sparkContext.defaultParallelism, -(-counts.count() // BLOCK_CELLS))
    keys = _block_keys(spark, n)
    block = F.element_at(F.array(*[F.lit(k).cast("bigint") for k in keys]), (F.pmod(F.xxhash64(id_col), F.lit(len(keys))) + 1).cast("int"))
    lists = {
        "words": pa.int64(), **{f"idf{k}": pa.float64() for k in ks}, "sizes": pa.int32(), "word": pa.int32(), "n": pa.int32(),
        **{f"{c}{k}": pa.float64() for k in ks for c in ("label", "share", "length")},
    }
    types = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double"}
    out = pa.schema([("block", pa.int64()), *[(c, pa.list_(t)) for c, t in lists.items()]])

    def build(key: tuple[pa.Scalar, ...], cells: pa.Table, marks: pa.Table) -> pa.Table:
        def row(**values: np.ndarray) -> dict[str, list]:
            return {"block": [key[0].as_py()], **{c: [values.get(c)] for c in lists}}

        ids = marks.column(id_col).combine_chunks()
        of_file = cells.column(id_col).combine_chunks()
        # Cells of files that are in no task are nobody's.
        at = pa.compute.index_in(of_file, value_set=ids)
        cells = cells.filter(at.is_valid())
        at = at.drop_null().to_numpy()
        order = np.argsort(at, kind="stable")
        numbers, first, place = np.unique(cells.column("word_no").to_numpy(), return_index=True, return_inverse=True)
        idf = {k: np.append(np.nan_to_num(cells.column(f"idf{k}").to_numpy()[first]), 0.0) for k in ks}
        sizes = np.bincount(at, minlength=len(ids))
        place, n, at = place[order].astype(np.int32), cells.column("n").to_numpy()[order], at[order]
        made = [row(words=np.append(numbers, START), **{f"idf{k}": idf[k] for k in ks})]
        length = {k: np.sqrt(np.bincount(at, (n * idf[k][place]) ** 2, len(ids))) for k in ks}
        ends = np.append(0, np.cumsum(sizes))
        given = {f"{c}{k}": marks.column(f"{c}{k}").to_numpy() for k in ks for c in ("label", "share")}
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_CELLS, "right")) - 1)
            stop = min(stop, start + CHUNK_CELLS, len(ids))
            some, within = slice(start, stop), slice(ends[start], ends[stop])
            made.append(
                row(
                    sizes=sizes[some], word=place[within], n=n[within],
                    **{c: v[some] for c, v in given.items()}, **{f"length{k}": length[k][some] for k in ks},
                )
            )
            start = stop
        return pa.Table.from_pydict({c: sum((m[c] for m in made), []) for c in out.names}, schema=out)

    schema = ", ".join(["block bigint", *[f"`{c}` array<{types[t]}>" for c, t in lists.items()]])
    built = (
        cells.withColumn("block", block).groupBy("block").cogroup(marks.withColumn("block", block).groupBy("block")).applyInArrow(build, schema)
    )
    return _bucketed(built, "block", (), n)


def _block_step(n_tasks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Gradients at ``ahead`` and held-out counts at ``weight`` of one block, by word number."""
    ks = range(n_tasks)

    def values(column: pa.Array) -> np.ndarray:
        return column.values.to_numpy(zero_copy_only=False)

    def step(features: pa.Table, state: pa.Table) -> pa.Table:
        rows = [features.slice(i, 1).combine_chunks() for i in range(features.num_rows)]
        lists = [{c: r.column(c)[0] for c in r.column_names} for r in rows]
        head = next(r for r in lists if r["words"].is_valid)
        numbers, place = values(head["words"]), state.column("place").to_numpy()
        found = {c: np.zeros(len(numbers)) for k in ks for c in (f"weight{k}", f"ahead{k}")}
        for c, into in found.items():
            into[place] = state.column(c).to_numpy()
        gradient, cases = [np.zeros(len(numbers)) for _ in ks], np.zeros((n_tasks, len(CASES)))
        for chunk in lists:
            if not chunk["sizes"].is_valid:
                continue
            sizes, word, n = values(chunk["sizes"]), values(chunk["word"]), values(chunk["n"])
            at = np.repeat(np.arange(len(sizes)), sizes)
            for k in ks:
                idf, length = values(head[f"idf{k}"]), values(chunk[f"length{k}"])
                label, share = values(chunk[f"label{k}"]), values(chunk[f"share{k}"])
                scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
                x = n * idf[word] * scale[at]
                margin = np.bincount(at, x * found[f"ahead{k}"][word], len(sizes)) + found[f"ahead{k}"][-1]
                score = np.bincount(at, x * found[f"weight{k}"][word], len(sizes)) + found[f"weight{k}"][-1]
                with np.errstate(over="ignore"):
                    miss = np.nan_to_num(share * (1.0 / (1.0 + np.exp(-margin)) - label))
                gradient[k] += np.bincount(word, x * miss[at], len(numbers))
                gradient[k][-1] += miss.sum()
                held_out, yes = np.isnan(share), score >= 0
                cases[k] += [(held_out & (label == y) & (yes == said)).sum() for y, said in ((0, False), (0, True), (1, False), (1, True))]
        columns = [np.append(gradient[k], cases[k]) for k in ks]
        return pa.Table.from_arrays([pa.array(np.append(numbers, list(CASES.values()))), *map(pa.array, columns)], names=["word_no", *[f"g{k}" for k in ks]])

    return step


def _fit_blocks(
    counts: DataFrame, rows: DataFrame, vocabulary: DataFrame, weights: DataFrame, settings: LinearSettings, id_col: str
) -> LinearFit:
    """``fit_linear`` for any number of weights: no step moves features, sorts them or broadcasts weights."""
    spark = counts.sparkSession
    # One row per task of a registry.
    tasks = sorted(r.task for r in weights.select("task").collect())
    ks = range(len(tasks))
    idfs = [F.max(F.when(F.col("task") == t, F.col("idf"))).alias(f"idf{k}") for k, t in enumerate(tasks)]
    words = materialize(materialize(vocabulary.groupBy("word").agg(*idfs)).withColumn("word_no", F.monotonically_increasing_id()))
    features, name = _block_table(counts, rows, words, tasks, id_col)
    needed = features.where("words is not null").select("block", F.posexplode("words").alias("place", "word_no"))
    needs, needs_name = _bucketed(needed, "word_no", ())
    others = spark.createDataFrame([(n,) for n in (START, *CASES.values())], "word_no bigint")
    state = words.select("word_no").unionByName(others).select("word_no", *[F.lit(0.0).alias(f"{c}{k}") for k in ks for c in ("weight", "ahead")])
    step_of_block = _block_step(len(tasks))
    states, measured = [], []
    for step in range(1, settings.steps + 2):
        sent = needs.join(state.hint("shuffle_hash"), "word_no").select("block", "place", *[f"{c}{k}" for k in ks for c in ("weight", "ahead")])
        schema = ", ".join(["word_no bigint", *[f"g{k} double" for k in ks]])
        parts = features.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(step_of_block, schema)
        sums = parts.groupBy("word_no").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in ks])
        shrink = F.when(F.col("word_no") == START, 0.0).otherwise(settings.decay)
        columns = []
        for k in ks:
            weight, ahead, gradient = F.col(f"weight{k}"), F.col(f"ahead{k}"), F.coalesce(f"g{k}", F.lit(0.0))
            after = ahead - settings.rate * (gradient + shrink * ahead)
            onward = after + (step - 1) / (step + 2) * (after - weight)
            columns += [after.alias(f"weight{k}"), onward.alias(f"ahead{k}"), F.when(F.col("word_no") < START, F.col(f"g{k}")).alias(f"g{k}")]
        stored = materialize(state.join(sums.hint("shuffle_hash"), "word_no", "left").select("word_no", *columns))
        # A pass counts for the weights it starts from: those of step 0 are none.
        if step > 1:
            counted = stored.where(F.col("word_no") < START)
            for k, t in enumerate(tasks):
                sides = [F.max(F.when(F.col("word_no") == n, F.col(f"g{k}"))).cast("bigint").alias(c) for c, n in CASES.items()]
                measured.append(counted.agg(*sides).select(F.lit(t).alias("task"), F.lit(step - 1).alias("step"), *CASES))
        states.append(stored)
        state = stored.select("word_no", *[f"{c}{k}" for k in ks for c in ("weight", "ahead")])
    for table in (name, needs_name):
        spark.sql(f"DROP TABLE {table}")
    history, best = _measured(measured, settings)
    # One row per task: only the weights of its best step are read.
    chosen = {r.task: r.step for r in best.collect()}
    start = spark.createDataFrame([(INTERCEPT, START)], "word string, word_no bigint")
    named = words.unionByName(start, allowMissingColumns=True)
    kept = [
        states[chosen[t] - 1]
        .select("word_no", F.col(f"weight{k}").alias("weight"))
        .join(named.where((F.col(f"idf{k}").isNotNull()) | (F.col("word_no") == START)), "word_no")
        .select(F.lit(t).alias("task"), "word", F.col(f"idf{k}").alias("idf"), "weight", F.lit(chosen[t]).alias("step"))
        for k, t in enumerate(tasks)
    ]
    return LinearFit(reduce(DataFrame.unionByName, kept), history)


def linear_scores(rows: DataFrame, counts: DataFrame, weights: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``rows`` of (task, ID, ...) with P(positive); NULL for a task that was not fitted."""
    known = rows.select("task", id_col).join(counts, id_col)
    cells = known.join(broadcast_if_small(weights.where("idf is not null")), ["task", "word"])
    raw = F.col("n") * F.col("idf")
    sums = cells.groupBy("task", id_col).agg(
        (F.sum(raw * F.col("weight")) / F.sqrt(F.sum(raw * raw))).alias("_words")
    )
    starts = weights.where("idf is null").select("task", F.col("weight").alias("_start"))
    margin = F.col("_start") + F.coalesce("_words", F.lit(0.0))
    scored = rows.join(sums, ["task", id_col], "left").join(F.broadcast(starts), "task", "left")
    return scored.select(*rows.columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("p_yes"))

"""Models over tables: batch scoring, transform with retry, a linear text baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from corpusmill.functions.quality import DEFAULT_RULES, QualityRules, hard_flags, quality_flags
from corpusmill.functions.text import word_chunks, words
from corpusmill.plans.materialize import materialize

Scorer = Callable[[list[str]], Sequence[float]]
Transform = Callable[[list[str], int], Sequence[str]]


def chunk_rows(
    df: DataFrame, max_length: int, max_chunks: int, side: str = "head", reserve: int = 2, text: str = "text"
) -> DataFrame:
    """One row per word window of each text."""
    rest = [c for c in df.columns if c != text]
    return df.select(
        *rest, F.posexplode(word_chunks(text, max_length, max_chunks, side, reserve)).alias("chunk_no", "tokens")
    )


def mean_pool(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Mean vector per group; groups without vectors do not occur.

    Positions are averaged separately with map-side sums, so a group of any size moves
    only its sums; the final list is as long as a vector.
    """
    cells = df.select(id_col, F.posexplode(vector).alias("_position", "_value"))
    means = cells.groupBy(id_col, "_position").agg(F.avg(F.col("_value").cast("double")).alias("_mean"))
    return means.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_position", "_mean"))).alias("_cells")
    ).select(id_col, F.col("_cells._mean").alias(vector))


def batch_score(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "text",
    score: str = "p_yes",
    batch_size: int = 64,
) -> DataFrame:
    """Add a score per text; ``make_scorer`` builds the model once per task."""
    schema = StructType([*df.schema.fields]).add(score, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores: list[float] = []
            for start in range(0, len(texts), batch_size):
                scores.extend(float(s) for s in scorer(texts[start : start + batch_size]))
            yield batch.append_column(score, pa.array(scores, pa.float64()))

    return df.mapInArrow(run, schema)


def _apply(df: DataFrame, make: Callable[[], Transform], attempt: int, batch_size: int) -> DataFrame:
    schema = StructType([*df.schema.fields]).add("out", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transform = make()
        for batch in batches:
            texts = batch.column("src").to_pylist()
            outs: list[str] = []
            for start in range(0, len(texts), batch_size):
                outs.extend(transform(texts[start : start + batch_size], attempt))
            yield batch.append_column("out", pa.array(outs, pa.string()))

    return df.mapInArrow(run, schema)


def transform_with_retry(
    df: DataFrame,
    make: Callable[[], Transform],
    retries: int = 2,
    rules: QualityRules = DEFAULT_RULES,
    batch_size: int = 64,
) -> DataFrame:
    """Transform ``src`` texts, check the pairs, and redo only those with hard flags.

    Each round is materialized, so a model that is not deterministic runs once per row
    and round. The last round keeps whatever flags remain.
    """
    todo, finished = df, None
    for attempt in range(retries + 1):
        tried = materialize(
            _apply(todo, make, attempt, batch_size)
            .withColumn("flags", quality_flags("src", "out", rules))
            .withColumn("attempt", F.lit(attempt))
        )
        bad = F.size(hard_flags("flags")) > 0
        done = tried if attempt == retries else tried.where(~bad)
        finished = done if finished is None else finished.unionByName(done)
        todo = tried.where(bad).select(*df.columns)
        if attempt < retries and todo.isEmpty():
            break
    return finished


def fit_baseline(
    train: DataFrame, features: int = 1 << 18, text: str = "text", weight: str | None = None, reg: float = 0.01
):
    """Linear classifier on TF-IDF words for one task, with an optional weight column."""
    options = {"weightCol": weight} if weight else {}
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", maxIter=20, regParam=reg, **options),
    ]
    return Pipeline(stages=stages).fit(train)


def baseline_scores(model, rows: DataFrame) -> DataFrame:
    """Rows with P(positive) of a fitted baseline."""
    scored = model.transform(rows).withColumn("p_yes", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "p_yes")


def word_counts(docs: DataFrame, id_col: str = "file_id", text: str = "text") -> DataFrame:
    """How often each word, in lower case, stands in each text."""
    spread_words = docs.select(id_col, F.explode(words(F.lower(F.col(text)))).alias("word"))
    return spread_words.groupBy(id_col, "word").agg(F.count("*").alias("n"))


def word_baseline(
    counts: DataFrame, splits: DataFrame, weights: DataFrame, id_col: str = "file_id", smoothing: float = 1.0
) -> DataFrame:
    """Test rows of every task with P(positive) of a class-weighted naive Bayes over words.

    ``counts`` comes from ``word_counts``, ``splits`` has ``task``, ``label`` and ``split``, ``weights`` comes
    from ``class_weights``. All tasks are fitted in one pass. The log-odds of a text are averaged
    over the words that training has seen; a text without such words gets one half.
    """
    train = splits.where("split = 'train'").join(counts, id_col)

    def seen(label: int) -> Column:
        return F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))

    per_word = train.groupBy("task", "word").agg(seen(0).alias("n_neg"), seen(1).alias("n_pos"))
    totals = per_word.groupBy("task").agg(
        F.sum("n_neg").alias("t_neg"), F.sum("n_pos").alias("t_pos"), F.count("*").alias("_size")
    )
    # One row per task of a registry.
    scale = F.broadcast(totals.join(weights.select("task", "weight_neg", "weight_pos"), "task"))

    def likelihood(side: str) -> Column:
        weight = F.col(f"weight_{side}")
        return (F.col(f"n_{side}") * weight + smoothing) / (F.col(f"t_{side}") * weight + smoothing * F.col("_size"))

    model = per_word.join(scale, "task").select(
        "task", "word", (F.log(likelihood("pos")) - F.log(likelihood("neg"))).alias("log_odds")
    )
    test = splits.where("split = 'test'").select("task", id_col, "label")
    sums = (
        test.join(counts, id_col)
        .join(model, ["task", "word"])
        .groupBy("task", id_col)
        .agg((F.sum(F.col("n") * F.col("log_odds")) / F.sum("n")).alias("_mean"))
    )
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.coalesce("_mean", F.lit(0.0))))
    return test.join(sums, ["task", id_col], "left").select("task", id_col, "label", score.alias("p_yes"))

"""Quality rules as weak supervision.

Each rule votes good, poor, or abstains. How far a rule can be trusted is not set by hand:
expectation-maximisation over all documents estimates, for each rule, how often it gives
each vote on good and on poor documents, and how many documents are good. The posterior
probability of being good then decides, in place of a demand that all rules pass.

Documents with the same votes are counted together, so the iteration runs over at most
3^rules rows. Everything is DataFrame expressions; no text leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WHITE, WHITE_CLASS, bind, stage, whole_text, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class RuleLimits:
    """Per rule (good up to, poor from) a value of its measure; between, it abstains.

    Most rules know only signs of poor text: with a negative first limit they never vote good.
    """

    limits: Mapping[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "symbol_rate": (-1.0, 0.10),
            "symbol_run_rate": (-1.0, 0.05),
            "repeat_share": (-1.0, 0.28),
            "line_repeat_share": (-1.0, 0.50),
            "word_length_off": (-1.0, 4.0),
            "capital_share": (-1.0, 0.30),
            "exclamation_rate": (-1.0, 0.25),
            "adjacent_repeat_share": (-1.0, 0.12),
            "sameness": (0.50, 0.75),
        }
    )
    threshold: float = 0.5
    rounds: int = 30
    tolerance: float = 1e-4


def _windows(hashes: Column) -> Column:
    """Hash of each stretch of WINDOW words, from word hashes."""
    last = F.size(hashes) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, the first occurrence included.

    Sorted by hash, equal windows are neighbours; their starts, sorted again, cover
    WINDOW words each, less what the next one covers too.
    """
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(rows: Column) -> Column:
        same = F.filter(
            rows,
            lambda r, k: (F.get(rows, k - 1)["w"].eqNullSafe(r["w"])) | (F.get(rows, k + 1)["w"].eqNullSafe(r["w"])),
        )
        return F.array_sort(F.transform(same, lambda r: r["i"]))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return bind(placed, lambda rows: bind(starts(rows), total))


def repeated_words(words: Column) -> Column:
    """Number of words inside repeated windows; texts without one skip the costly part."""

    def count(windows: Column) -> Column:
        any_twice = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(any_twice, _covered(windows)).otherwise(F.lit(0).cast("bigint"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bind(hashes, lambda h: bind(_windows(h), count))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text, NULL counting as empty, and the measures that the rules read."""
    text = F.col("_text")
    length = F.length(text)
    bare = _without(text, " \\t-\\r")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)

    def of_words(words: Column) -> Column:
        follows = F.transform(words, lambda w, i: F.when(F.get(words, i + 1) == w, 1).otherwise(0))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.aggregate(follows, F.lit(0), lambda a, x: a + x).alias("n_adjacent"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
        )

    def of_lines(rows: Column) -> Column:
        return F.struct(
            F.size(rows).alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint").alias("n_dup_lines"),
        )

    counted = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text")).select(
        "doc_id",
        bare.cast("bigint").alias("word_chars"),
        (length - _without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]+")).alias("n_symbol_runs"),
        (length - _without(text, "!")).alias("n_exclamations"),
        (length - _without(text, "\\p{Lu}")).alias("n_capitals"),
        bind(words_of(text), of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
    )
    n_words, repeats = F.col("w.n_words"), F.col("w.n_repeat_words")
    words = F.greatest(n_words, F.lit(1))
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    return counted.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_symbol_runs") / words).alias("symbol_run_rate"),
        (repeats / words).alias("repeat_share"),
        (F.col("l.n_dup_lines") / F.greatest(F.col("l.n_lines"), F.lit(1))).alias("line_repeat_share"),
        F.abs(F.col("word_chars") / words - 6.0).alias("word_length_off"),
        (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_share"),
        (F.col("n_exclamations") / words).alias("exclamation_rate"),
        (F.col("w.n_adjacent") / words).alias("adjacent_repeat_share"),
        (1 - F.col("w.n_distinct") / words).alias("sameness"),
    )


def vote(measure: str, good: float, poor: float) -> Column:
    """1 for good, -1 for poor, 0 for no opinion."""
    value = F.col(measure)
    return F.when(value >= poor, F.lit(-1)).when(value <= good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, per rule, P(vote | good) and P(vote | poor) for votes -1, 0, 1."""

    prior: float
    good: dict[str, tuple[float, float, float]]
    poor: dict[str, tuple[float, float, float]]

    def posterior(self) -> Column:
        """Probability that a document is good, from its vote columns."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.good:
            for v, g, p in zip((-1, 0, 1), self.good[rule], self.poor[rule]):
                odds = odds + F.when(F.col(f"v_{rule}") == v, F.lit(math.log(g / p))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: DataFrame, limits: RuleLimits) -> LabelModel:
    """EM over the counted vote patterns (``v_<rule>`` and ``n``).

    Starts from rules that hardly ever take a good document for poor and see three in ten of the
    poor ones. Counts are smoothed with one imagined document per vote, so a rule that never votes
    stays neutral. Without documents the start stays.
    """
    rules = list(limits.limits)
    model = LabelModel(0.8, dict.fromkeys(rules, (0.002, 0.548, 0.45)), dict.fromkeys(rules, (0.3, 0.35, 0.35)))
    for _ in range(limits.rounds):
        weighed = patterns.withColumn("_p", model.posterior())
        good, all_docs = F.sum(F.col("n") * F.col("_p")), F.sum("n")
        sums = [
            F.sum(F.when(F.col(f"v_{r}") == v, F.col("n") * x).otherwise(0.0))
            for r in rules
            for v in (-1, 0, 1)
            for x in (F.col("_p"), 1 - F.col("_p"))
        ]
        found = [x or 0.0 for x in weighed.agg(good, all_docs, *sums).first()]
        n_good, n = found[:2]
        cells = iter(found[2:])
        goods, poors = {}, {}
        for r in rules:
            pairs = [(next(cells), next(cells)) for _ in range(3)]
            goods[r] = tuple((g + 1) / (n_good + 3) for g, _ in pairs)
            poors[r] = tuple((p + 1) / (n - n_good + 3) for _, p in pairs)
        after = LabelModel((n_good + 1) / (n + 2), goods, poors)
        moved = max([abs(after.prior - model.prior), *(abs(x - y) for r in rules for x, y in zip(goods[r] + poors[r], model.good[r] + model.poor[r]))])
        model = after
        if moved < limits.tolerance:
            break
    return model


def judge(docs: DataFrame, limits: RuleLimits = RuleLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base counts, ``base_failed``, ``kept`` and ``p_good``.

    Documents that fail the base limits do not stay and are not learnt from. Every row gives
    a row; a NULL or empty text has no words and fails.
    """
    votes = [vote(r, *limits.limits[r]).alias(f"v_{r}") for r in limits.limits]
    rows = stage(
        base_columns(docs, id_col, text_col).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *votes
        ),
        "votes",
    ).df
    # At most 3^rules rows, whatever the table.
    names = [f"v_{r}" for r in limits.limits]
    patterns = stage(rows.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit_label_model(patterns.df, limits)
    patterns.release()
    good = model.posterior()
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (good >= limits.threshold)).alias("kept"),
        good.alias("p_good"),
    )

"""Pair checks over tables: flags, counts, rates by label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.quality import (
    DEFAULT_RULES,
    HARD_FLAGS,
    MEASURES,
    QualityRules,
    flag_kind,
    flags_from_measures,
    hard_flags,
    pair_measures,
    rounded_measures,
    source_loop,
)
from corpusmill.functions.text import preview
from corpusmill.plans.prefix import value_stats


def check_pairs(
    pairs: DataFrame,
    src: str = "src",
    out: str = "out",
    rules: QualityRules = DEFAULT_RULES,
    details: bool = False,
) -> DataFrame:
    """Pairs with flags and stored numbers; always derived from the texts."""
    # A generator, so that filters on flags stay above it and each output is measured once; the loops
    # of a source are measured where its output loops, and for all only if their column is read.
    measured = pairs.select("*", F.inline(F.array(pair_measures(src, out, rules))))
    numbers = {name: F.col(name) for name in MEASURES}
    return measured.select(
        *pairs.columns,
        flags_from_measures(numbers, source_loop(src, rules), rules, details).alias("flags"),
        *[c.alias(name) for name, c in rounded_measures(numbers).items()],
        source_loop(src, rules).alias("src_loop"),
        "out_loop",
    )


# Names in stored records of flags that are called by their meaning here.
STORED_NAMES = {"arabic_residue": "script_residue", "pers": "placeholder"}


def stored_flags(flags: Column | str, names: Mapping[str, str] = STORED_NAMES) -> Column:
    """Flags of a stored record under the names used here; none for NULL."""

    def renamed(flag: Column) -> Column:
        for old, new in names.items():
            flag = F.regexp_replace(flag, rf"^{old}(?=\(|$)", new)
        return flag

    value = F.col(flags) if isinstance(flags, str) else flags
    return F.coalesce(F.transform(value, renamed), F.array().cast("array<string>"))


def current_flags(
    records: DataFrame,
    src: str = "src",
    out: str = "out",
    stored: str = "flags",
    rules: QualityRules = DEFAULT_RULES,
    names: Mapping[str, str] = STORED_NAMES,
) -> DataFrame:
    """Records with ``flags`` as of now: derived from the texts, stored ones only where a text is missing.

    Stored flags come from the checks of their time, so texts that are there always decide.
    """
    there = F.col(src).isNotNull() & F.col(out).isNotNull()
    # A generator keeps the measures of a text in one place, as in ``check_pairs``.
    derived = records.select(
        *[c for c in records.columns if c != stored],
        F.col(stored).alias("_stored"),
        F.inline(F.array(pair_measures(F.coalesce(src, F.lit("")), F.coalesce(out, F.lit("")), rules))),
    )
    flags = F.when(there, flags_from_measures({m: F.col(m) for m in MEASURES}, source_loop(src, rules), rules)).otherwise(stored_flags("_stored", names))
    return derived.select(*[c for c in records.columns if c != stored], flags.alias(stored))


def flagged(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("flags") > 0)


def damaged(checked: DataFrame, hard: tuple[str, ...] = HARD_FLAGS) -> DataFrame:
    """Pairs with a hard flag, and those flags alone in ``hard_flags``."""
    return checked.withColumn("hard_flags", hard_flags("flags", hard)).where(F.size("hard_flags") > 0)


def redo_candidates(
    stored: DataFrame, texts: DataFrame, id_col: str = "file_id", rules: QualityRules = DEFAULT_RULES
) -> DataFrame:
    """Stored outputs that fail the current checks against the current source texts."""
    pairs = stored.select(id_col, "out").join(texts.select(id_col, F.col("text").alias("src")), id_col)
    return damaged(check_pairs(pairs, rules=rules)).drop("src", "out")


def flag_counts(checked: DataFrame) -> DataFrame:
    """Pairs per flag kind, plus the clean and flagged totals."""
    kinds = F.when(F.size("flags") == 0, F.array(F.lit("(clean)"))).otherwise(
        F.array_append(F.transform("flags", flag_kind), F.lit("(flagged)"))
    )
    return checked.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def flag_rate_by_label(
    checked: DataFrame, labels: DataFrame, keys: Sequence[str] = ("task", "label"), id_col: str = "file_id"
) -> DataFrame:
    """Share of flagged pairs among the positives and negatives of each task."""
    marks = checked.select(id_col, (F.size("flags") > 0).alias("_flagged"))
    joined = labels.select(id_col, *keys).join(marks, id_col)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("_flagged").alias("n_flagged"),
        F.avg(F.col("_flagged").cast("double")).alias("flag_rate"),
    )


def ratio_stats(checked: DataFrame, keys: Sequence[str] = (), value: str = "len_ratio") -> DataFrame:
    """Count, exact median, smallest and largest value."""
    return value_stats(checked, keys, value)


def ratio_sketches(checked: DataFrame, keys: Sequence[str] = (), value: str = "len_ratio", k: int = 400) -> DataFrame:
    """A KLL sketch of the values per group: bounded in size, and mergeable with those of other batches.

    The rank of an answer is off by about 1.7 / ``k`` of the rows, at 99 percent confidence
    under twice that.
    """
    return checked.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"),
        F.count("*").alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = 400) -> DataFrame:
    """One sketch per group from those of all its batches."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def sketched_quantile(rank: float) -> Column:
    """The value at a rank between 0 and 1 from the column ``sketch``."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(rank))


def flagged_preview(checked: DataFrame, n: int, width: int = 900, id_col: str = "file_id") -> DataFrame:
    """The first ``n`` flagged pairs by ID, texts cut for reading."""
    return (
        flagged(checked)
        .orderBy(id_col)
        .limit(n)
        .select(id_col, "flags", "len_ratio", preview("src", width).alias("src"), preview("out", width).alias("out"))
    )

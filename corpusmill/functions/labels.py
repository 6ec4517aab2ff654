"""Labels: signatures, binary values, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE_CLASS, col, let, strip

# Answer words and cell values with a binary meaning.
POSITIVE_WORDS = ("yes", "true", "1", "positive")
NEGATIVE_WORDS = ("no", "false", "0", "negative")
BINARY_CELLS = {"TRUE": 1, "FALSE": 0}


def clean_labels(df: DataFrame, labels: Sequence[str], strip_values: bool = True) -> DataFrame:
    """Label columns with NULL as blank, stripped if asked; other columns unchanged."""
    fix = strip if strip_values else (lambda c: F.coalesce(F.col(c), F.lit("")))
    return df.withColumns({c: fix(c) for c in labels})


def signature(labels: Sequence[str], strip_values: bool = True) -> Column:
    """One comparable value for all labels of a row; case matters."""
    fix = strip if strip_values else (lambda c: F.coalesce(F.col(c), F.lit("")))
    return F.struct(*[fix(c).alias(c) for c in labels])


def cell_text(c: Column | str) -> Column:
    return F.upper(strip(c))


def to_binary_label(c: Column | str) -> Column:
    """1 or 0 for a TRUE or FALSE cell in any case, else NULL."""
    text = cell_text(c)
    out = None
    for cell, value in BINARY_CELLS.items():
        out = F.when(text == cell, value) if out is None else out.when(text == cell, value)
    return out.cast("int")


def label_to_text(c: Column | str, positive: str = "Yes", negative: str = "No") -> Column:
    return F.when(col(c).cast("int") == 1, F.lit(positive)).otherwise(F.lit(negative))


def parse_answer(c: Column | str) -> Column:
    """Free-text answer as 1, 0 or NULL.

    The first known answer word decides, with only ``.`` and ``,`` as extra
    separators; failing that, a leading yes or no.
    """
    text = F.lower(strip(c))
    tokens = F.split(F.translate(text, ".,", "  "), f"[{SPACE_CLASS}]+")
    known = F.filter(tokens, lambda t: t.isin(*POSITIVE_WORDS, *NEGATIVE_WORDS))
    return let(
        F.get(known, F.lit(0)),
        lambda first: F.when(first.isin(*POSITIVE_WORDS), 1)
        .when(first.isin(*NEGATIVE_WORDS), 0)
        .when(F.startswith(text, F.lit(POSITIVE_WORDS[0])), 1)
        .when(F.startswith(text, F.lit(NEGATIVE_WORDS[0])), 0),
    ).cast("int")

"""File and metadata IDs. An ID is a string of digits; leading zeros count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col, strip


def normalize_id(c: Column | str) -> Column:
    """Digits of a stripped token, without a ``.0`` artefact; blank when not an ID."""
    return F.regexp_extract(strip(c), r"\A(\p{Nd}+)(?:\.0+)?\z", 1)


def extract_file_id(c: Column | str, suffix: str) -> Column:
    """ID block of a file name: after the last ``_``, before ``suffix`` or the extension."""
    name = col(c)
    stem = F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")
    if suffix:
        known = F.substring(name, F.lit(1), F.length(name) - F.lit(len(suffix)))
        stem = F.when(F.endswith(name, F.lit(suffix)), known).otherwise(stem)
    return normalize_id(F.substring_index(stem, "_", -1))


def id_order(c: str) -> list[Column]:
    """Sort keys: numeric IDs by value, then all others by text."""
    return [F.expr(f"try_cast(`{c}` as decimal(38,0))").asc_nulls_last(), F.col(c)]

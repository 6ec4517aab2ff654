"""Folders of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip


def plain_path(c: Column | str) -> Column:
    """File path or name without URI escapes."""
    return F.url_decode(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Names of the matching files directly in ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(plain_path("_metadata.file_name").alias("text_file"))


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file directly in ``folder``: name and stripped text."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(plain_path("_metadata.file_name").alias("text_file"), strip("value").alias("text"))

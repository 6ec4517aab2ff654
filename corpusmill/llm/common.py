"""Small helpers that the operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.materialize import scratch_path

# White space of the query contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[ \\t-\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order, as an array."""
    parts = F.split(text, f"{WHITE_CLASS}+")
    return F.filter(parts, lambda w: w != F.lit(""))


def key_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the ID as text, modulo ``modulus``: decides which labels may be learnt."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


@dataclass(frozen=True)
class Stage:
    """A table in the shared folder: cuts lineage, survives lost executors, can be freed."""

    df: DataFrame
    path: str

    def release(self) -> None:
        spark = self.df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> Stage:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return Stage(df.sparkSession.read.schema(df.schema).parquet(path), path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions for ``mapInArrow`` are looked up by name there; the workers need not have the
    package installed.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / package.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(app)


# Rows of a few numbers each that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of narrow rows, to broadcast if it has at most ``max_rows``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column has the name."""
    while base.lower() in [c.lower() for c in df.columns]:
        base += "_"
    return base


def own_names(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{w}`") for w in wanted])


def learnable_labels(labels: DataFrame, id_col: str, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """(ID, 0/1) of a bounded sample of the labelled rows that may be learnt from.

    Rows with a NULL ID or label are left out; of several rows of one ID the largest label
    counts. ``max_rows`` bounds the sample in expectation.
    """
    usable = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    return bounded_sample(usable, max_rows)


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """Rows (unique ``_id``) whose ID's hash lies in a share of the range worth ``max_rows`` rows."""
    total = rows.count()
    if total <= max_rows:
        return rows
    share = int(max_rows / total * 2**31)
    return rows.where(F.pmod(F.xxhash64("_id"), F.lit(2**31)) < share)

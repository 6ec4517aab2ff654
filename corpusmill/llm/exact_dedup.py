"""Exact duplicates through a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct normalised text,
with the ID of the document that stands for it. A batch is reduced to one row per digest
(partial aggregation, so a text that a third of all rows share is a few rows per task),
checked against the index by a sort-merge anti-join that reads the index without a
shuffle, and appended. Text is read once and never shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.llm.common import WHITE_CLASS, Stage, broadcast_if_small, own_names, stage, unused_name, whole_text
from corpusmill.plans.materialize import scratch_path

INDEX_SCHEMA = "digest binary, keep_id bigint, n_chars int"


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+", ""), 256))


@dataclass(frozen=True)
class DigestIndex:
    """Handle of an index: a catalog name over files at ``path``."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, name: str, path: str, buckets: int) -> DigestIndex:
        """Create the index, or attach the files that an earlier session left at ``path``.

        The number of buckets is stored beside the files; another one would look for digests
        in the wrong buckets, and fails.
        """
        settings = f"{path.rstrip('/')}-settings"
        try:
            stored = spark.read.schema("buckets int").parquet(settings).first().buckets
        except AnalysisException:
            stored = buckets
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(settings)
        if stored != buckets:
            raise ValueError(f"the index at {path} has {stored} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, name, path, buckets)

    @staticmethod
    def scratch(spark: SparkSession) -> DigestIndex:
        """A new index below the shared folder, as many buckets as shuffle partitions."""
        name = f"digest_index_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return DigestIndex.open(spark, name, scratch_path(spark, name), buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` that the index lacks.

        The anti-join also makes a repeated append harmless, as after a failure half-way.
        """
        fresh = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        (
            own_names(fresh, "digest", "keep_id", "n_chars")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Stage:
    """One narrow row per document: ID, digest, code points of the original text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.length(whole_text(text_col)).alias("n_chars")
    )
    return stage(rows, "digests")


def digest_groups(rows: DataFrame) -> DataFrame:
    """Per digest: the row with the most code points, then the smallest ID; and the size.

    A NULL ID is kept only where its text has no row with an ID as long.
    """
    order = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull(), -F.col("doc_id"))
    return rows.groupBy("digest").agg(
        F.max(order).alias("_best"), F.count("*").alias("group_size")
    ).select("digest", (-F.col("_best.col3")).alias("keep_id"), F.col("_best.n_chars").alias("n_chars"), "group_size")


def mark_duplicates(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Append the batch to the index; one row per document with the ID that stands for its text.

    A text that an earlier batch brought keeps the representative of that batch, so that a
    batch sent again gets the same marks. ``group_size`` counts the rows of this batch. Empty
    texts are equal to each other and to texts of white space only. A row repeated with its ID
    and text has a line per repetition, each marked as kept; of rows that share an ID and a text
    but for white space, only those of the longest original are. An empty batch gives no rows.
    """
    return own_names(_decided(rows, index), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """The marks, with the digest and the code points of each row."""
    groups = digest_groups(rows)
    index.append(groups)
    sizes = groups.select("digest", "group_size")
    # As a table of its own, the decisions are shuffled like the rows, and a text that many
    # rows share can be split over tasks.
    known = index.table().select("digest", "keep_id", F.col("n_chars").alias("_longest"))
    decided = stage(known.join(sizes.hint("merge"), "digest"), "decided").df
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("_longest"))
    return rows.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        same.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "digest",
        "n_chars",
    )


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; one of rows that share ID and text but for white space."""
    marks = stage(_decided(digest_rows(docs, id_col, text_col).df, index), "marks").df
    # Where few rows go, the texts need no shuffle.
    gone = broadcast_if_small(marks.where("not kept").select("doc_id", "digest", "n_chars"))
    here = (
        docs[id_col].eqNullSafe(gone["doc_id"])
        & (digest(docs[text_col]) == gone["digest"])
        & (F.length(F.coalesce(docs[text_col], F.lit(""))) == gone["n_chars"])
    )
    left = docs.join(gone, here, "left_anti")
    repeated = marks.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    again = left[id_col].eqNullSafe(repeated["doc_id"])
    single = left.join(repeated, again, "left_anti")
    several, mark = left.join(repeated, again, "left_semi"), unused_name(docs, "_digest")
    once = several.withColumn(mark, digest(F.col(text_col))).dropDuplicates([id_col, mark]).drop(mark)
    return single.unionByName(once)

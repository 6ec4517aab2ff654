"""Queries that run as streams over the files of a table and stop when all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.quality import ORACLES as QUALITY_ORACLES
from corpusmill.catalog.views import LABELS, RULES, SUFFIX, with_views
from corpusmill.plans.materialize import scratch_path
from corpusmill.streaming import match, pairs, reconcile

# Files per micro-batch; each batch scans the stored side of its join once.
FILES_PER_TRIGGER = 64


def _stream(spark, d, name, files_per_trigger=FILES_PER_TRIGGER):
    """The files of a table as a stream; a table of one file is read through its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    one_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(v.table(spark, d, name).schema).option("maxFilesPerTrigger", files_per_trigger)
    if one_file:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(f"{d}/{name}.parquet")


def stream_match(spark, d):
    names = _stream(spark, d, "orders").select(v.text_file_name().alias("text_file"))
    out = scratch_path(spark, "stream_match")
    matched = match.stream_match(names, v.metadata(spark, d), SUFFIX)
    match.run_available(matched, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(matched.schema).parquet(f"{out}/rows")


def stream_unmatched(spark, d):
    names = _stream(spark, d, "orders").select(v.text_file_name().alias("text_file"))
    out = scratch_path(spark, "stream_unmatched")
    report = match.stream_unmatched(names, v.metadata(spark, d), SUFFIX)
    match.run_available(report, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(report.schema).parquet(f"{out}/rows")


def stream_pair_quality(spark, d):
    cores = spark.sparkContext.defaultParallelism
    docs = _stream(spark, d, "documents").select("doc_id", F.col("text").alias("src")).repartition(cores, "doc_id")
    landed = docs.join(v.successors(spark, d), "doc_id").select(
        F.col("doc_id").alias("file_id"), F.col("doc_id").alias("seq"), "src", "out"
    )
    out = scratch_path(spark, "stream_pairs")
    pairs.run_pair_checks(landed, f"{out}/rows", f"{out}/checkpoint", RULES)
    return pairs.current_pairs(spark, f"{out}/rows").select(
        "file_id",
        F.array_join("flags", ",").alias("flags"),
        "len_ratio",
        "residue_ratio",
        "marks_src",
        "marks_out",
        F.round("src_loop", 9).alias("src_loop"),
        F.round("out_loop", 9).alias("out_loop"),
    )


def _metadata_stream(spark, d):
    return v.metadata_of(_stream(spark, d, "lineitem"))


def stream_usable(spark, d):
    """Metadata rows land as a stream; the state of all IDs gives the usable files."""
    checkpoint = scratch_path(spark, "stream_usable")
    reconcile.run_agreement(_metadata_stream(spark, d), LABELS, checkpoint)
    return reconcile.current_usable(v.text_files(spark, d), checkpoint)


def stream_agreement(spark, d):
    checkpoint = scratch_path(spark, "stream_agreement")
    reconcile.run_agreement(_metadata_stream(spark, d), LABELS, checkpoint)
    return reconcile.current_counts(v.text_files(spark, d), checkpoint)


QUERIES = {
    "stream_match": stream_match,
    "stream_unmatched": stream_unmatched,
    "stream_pair_quality": stream_pair_quality,
    "stream_usable": stream_usable,
    "stream_agreement": stream_agreement,
}

ORACLES = {
    "stream_match": with_views("SELECT * FROM matches", "matches"),
    "stream_unmatched": with_views(
        """SELECT text_file, file_id, CASE WHEN file_id = '' THEN 'invalid_filename_id' ELSE 'no_metadata_match' END AS reason
        FROM files WHERE file_id NOT IN (SELECT file_id FROM ids)""",
        "files",
        "ids",
    ),
    "stream_pair_quality": QUALITY_ORACLES["pair_quality"],
    "stream_usable": with_views("SELECT * FROM usable", "usable"),
    "stream_agreement": with_views(
        """SELECT CAST(count(*) FILTER (n_metadata_rows = 1) AS BIGINT) AS single_row, count(*) FILTER (n_metadata_rows > 1) AS multiple_rows,
            count(*) FILTER (n_metadata_rows > 1 AND k = 1) AS identical, count(*) FILTER (n_metadata_rows > 1 AND k > 1) AS conflicting
        FROM files f JOIN agreed a ON f.file_id = a.file_id""",
        "files",
        "agreed",
    ),
}

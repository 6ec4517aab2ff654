"""Queries that write a table in one form or another, and read it back or compare it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.datasets import (
    _EXCLUDED,
    _MERGED,
    ORACLES as DATASET_ORACLES,
    _excluded,
    _labels,
    _merged_split,
    _split,
    split_sql,
)
from corpusmill.catalog.matching import _ORDERED, _PLACED
from corpusmill.catalog.quality import _CHECKED, _MEASURED, _WORDED
from corpusmill.catalog.views import GROUPS, LABELS, RULES, SEED, TEST_SIZE, with_views
from corpusmill.functions.quality import len_ratio
from corpusmill.operators import digests, guards, merging, pairs, quality, reconcile
from corpusmill.operators.ledger import Ledger
from corpusmill.plans.materialize import materialize, scratch_path
from corpusmill.plans.split import cuts_of_counts, hash_counts, merge_hash_counts, split_by_cuts
from corpusmill.sources.datasets import read_manifests
from corpusmill.sources.json_arrays import read_json_arrays
from corpusmill.sources.metadata import read_csv
from corpusmill.sources.sinks import write_documents, write_json_arrays
from corpusmill.sources.store import replace_table

# Rank error that a sketch of this size stays under.
RANK_ERROR = 0.02


def manifest_document(spark, d):
    """A JSON document per group, written in parts by all tasks, read back as one row per ID."""
    labels, excluded = _labels(spark, d), _excluded(spark, d)
    ids = merging.manifest_ids(_merged_split(spark, d), excluded, merging.merge_labels(labels, GROUPS))
    counts = merging.merged_counts(labels, GROUPS, excluded)
    path = scratch_path(spark, "manifests")
    write_documents(merging.manifest_fragments(ids, counts, GROUPS, TEST_SIZE, SEED), path, ["section_no", "position"])
    return read_manifests(spark, path).select(
        F.col("group").alias("merged_task"), F.array_join("components", ",").alias("components"), "n_kept",
        "n_dropped_undetermined", "n_excluded", "test_size", "seed", "section", "position", "file_id",
    )


def duplicate_summary_file(spark, d):
    """The duplicate summary as one CSV file with a line per ID, read back."""
    summary = materialize(reconcile.duplicate_summary(v.text_files(spark, d), v.metadata(spark, d), LABELS))
    path = scratch_path(spark, "summary")
    write_documents(reconcile.summary_fragments(summary, LABELS), path, ["id_size", "file_id", "section", "position"])
    read = spark.read.option("header", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("row_count", "unique_prediction_count")}).withColumn(
        "predictions_same", F.col("predictions_same").cast("boolean")
    )


def array_layout(spark, d):
    """Both splits of all tasks as JSON array files, read back by byte ranges."""
    path = scratch_path(spark, "arrays")
    write_json_arrays(_split(spark, d), path)
    return read_json_arrays(spark, path, "file_id string, task string, label int, split string")


def csv_encodings(spark, d):
    """Documents as CSV, some files in UTF-8 and some in a Western code, read as one table."""
    docs = v.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("matched_ids"),
        F.substring(F.regexp_replace("text", "[^A-Za-zÀ-ÖØ-öø-ÿ, ]", ""), 1, 80).alias("note"),
        "lang",
    )
    path, western = scratch_path(spark, "csv"), F.col("lang").isin("fr", "es")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.where(~western).drop("lang").write.csv(f"{path}/a", **options)
    docs.where(western).drop("lang").write.csv(f"{path}/b", encoding="ISO-8859-1", **options)
    rows = materialize(read_csv(spark, [f"{path}/a", f"{path}/b"], number_rows=True))
    alone = rows.groupBy("metadata_row").agg(F.count("*").alias("_n"))
    n_rows = rows.count()
    fits = (F.col("_n") == 1) & F.col("metadata_row").between(2, n_rows + 1)
    return rows.join(alone, "metadata_row").select(F.col("matched_ids").cast("bigint").alias("doc_id"), "note", fits.alias("numbered"))


def ratio_sketch(spark, d):
    """Length ratios of pairs in ten batches of sketches, merged; the median's rank against the exact one."""
    ratios = materialize(v.translations(spark, d).select("file_id", len_ratio("src", "out").alias("len_ratio")))
    batches = quality.ratio_sketches(ratios.withColumn("batch", F.pmod("file_id", F.lit(10))), ["batch"])
    merged = quality.merge_sketches(batches)
    found = merged.select("n", "min", "max", quality.sketched_quantile(0.5).alias("median")).first()
    # Rows up to the sketched median, counted over all values.
    below = F.count_if(F.col("len_ratio") < found.median) <= F.lit(found.n * (0.5 + RANK_ERROR))
    upto = F.count_if(F.col("len_ratio") <= found.median) >= F.lit(found.n * (0.5 - RANK_ERROR))
    bounds = {"n": F.lit(found.n).cast("bigint"), "min": F.round(F.lit(found.min), 9), "max": F.round(F.lit(found.max), 9)}
    return ratios.agg((below & upto).alias("median_within_bound")).withColumns(bounds)


def pending_ledger(spark, d):
    """What ``pending_rows`` gives, from a ledger that was filled in two batches."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.md5("text").alias("text"))
    done = v.table(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    ledger = Ledger.create(spark, scratch_path(spark, "ledger"), id_type="bigint", buckets=8)
    ledger.add(done.where("file_id % 2 = 0"))
    ledger.add(done)
    return ledger.pending(docs)


def stored_flags(spark, d):
    """Pairs of which every third has lost its source text: its stored flags stand in."""
    pairs_ = v.translations(spark, d)
    stored = F.when(
        F.length("src") % 2 == 0, F.array(F.lit("pers(1->0)"), F.lit("too_long(2.60)"))
    ).otherwise(F.array(F.lit("arabic_residue(0.20)")))
    records = pairs_.withColumn("flags", stored).withColumn("src", F.when(F.col("file_id") % 3 != 0, F.col("src")))
    current = quality.current_flags(records, rules=RULES)
    hard = quality.damaged(current.select("file_id", "flags"))
    return current.select("file_id", F.array_join("flags", ",").alias("flags")).join(
        hard.select("file_id", F.array_join("hard_flags", ",").alias("hard_flags")), "file_id", "left"
    )


def upsert_in_place(spark, d):
    """What ``upsert_pairs`` gives, written over the table that it reads."""
    docs = v.table(spark, d, "documents").select(
        F.col("source").alias("file_id"), F.col("doc_id").alias("seq"), "lang", F.md5("text").alias("out")
    )
    path = scratch_path(spark, "store")
    replace_table(docs.drop("lang"), path)
    fresh = docs.select(F.concat(F.lit("lang-"), "lang").alias("file_id"), "seq", "out")
    redone = docs.where("lang = 'fr'").drop("lang").unionByName(fresh)
    replace_table(pairs.upsert_pairs(spark.read.parquet(path), redone), path)
    return spark.read.parquet(path)


def split_from_counts(spark, d):
    """The split from stored counts of hashes that two batches of labels were merged into."""
    labels = _labels(spark, d)
    early = F.pmod(F.crc32("file_id"), F.lit(3)) > 0
    stored = materialize(hash_counts(labels.where(early), ["task"], "label", "file_id", SEED))
    fresh = hash_counts(labels.where(~early), ["task"], "label", "file_id", SEED)
    counts = materialize(merge_hash_counts(stored, fresh))
    return split_by_cuts(labels, cuts_of_counts(counts, ["task"], "label", TEST_SIZE), ["task"], "label", "file_id", SEED)


def label_tree(spark, d):
    """Two label tables that differ in one task: their digests' sizes, and the rows found by them."""
    labels = _labels(spark, d)
    other = materialize(labels.where("task <> 'error'").unionByName(labels.where("task = 'error' and label = 0")))
    keys = ["file_id", "task"]
    trees = [digests.digest_tree(t, keys) for t in (labels, other)]
    diff = guards.label_map_diff(labels, other, keys, *trees)
    sizes = [t.where("level = 0").first().n for t in trees]
    return diff.select(*keys, "left_label", F.lit(sizes[0]).cast("bigint").alias("n_left"), F.lit(sizes[1]).cast("bigint").alias("n_right"))


QUERIES = {
    "manifest_document": manifest_document,
    "duplicate_summary_file": duplicate_summary_file,
    "array_layout": array_layout,
    "csv_encodings": csv_encodings,
    "ratio_sketch": ratio_sketch,
    "pending_ledger": pending_ledger,
    "stored_flags": stored_flags,
    "upsert_in_place": upsert_in_place,
    "split_from_counts": split_from_counts,
    "label_tree": label_tree,
}

_COMPONENTS = "CASE merged_task " + " ".join(f"WHEN '{g}' THEN '{','.join(t)}'" for g, t in GROUPS.items()) + " END"
_HARD_KINDS = "('empty', 'refusal', 'too_short', 'script_residue', 'degenerate')"

ORACLES = {
    "manifest_document": with_views(
        f"""SELECT l.merged_task, {_COMPONENTS.replace('merged_task', 'l.merged_task')} AS components, n_kept, n_dropped_undetermined, n_excluded,
            CAST({TEST_SIZE} AS DOUBLE) AS test_size, {SEED} AS seed, section,
            CAST(row_number() OVER (PARTITION BY l.merged_task, section ORDER BY file_id) - 1 AS INTEGER) AS position, file_id
        FROM (SELECT merged_task, split AS section, file_id FROM splits
            UNION ALL SELECT merged_task, 'excluded', file_id FROM merged WHERE file_id IN (SELECT file_id FROM gone_ids)) l
        JOIN counts c ON l.merged_task = c.merged_task""",
        "last_labels",
        gone_ids=_EXCLUDED,
        merged=_MERGED.format(source="last_labels"),
        counts="""SELECT merged_task, count(*) FILTER (NOT gone AND label IS NOT NULL) AS n_kept,
            count(*) FILTER (NOT gone AND label IS NULL) AS n_dropped_undetermined, count(*) FILTER (gone) AS n_excluded
            FROM (SELECT *, file_id IN (SELECT file_id FROM gone_ids) AS gone FROM merged) GROUP BY merged_task""",
        remaining="SELECT * FROM last_labels WHERE file_id NOT IN (SELECT file_id FROM gone_ids)",
        merged_rest=_MERGED.format(source="remaining"),
        known="SELECT * FROM merged_rest WHERE label IS NOT NULL",
        splits=split_sql("known", "merged_task"),
    ),
    "duplicate_summary_file": with_views(
        f"""SELECT file_id, count(*) AS row_count, any_value(k) AS unique_prediction_count, any_value(k) = 1 AS predictions_same,
            string_agg(CAST(metadata_row AS VARCHAR), ',' ORDER BY position) AS metadata_rows,
            string_agg(matched_ids, ' | ' ORDER BY position) FILTER (first_of_cell) AS matched_ids_values,
            any_value(label_a) AS label_a, any_value(label_b) AS label_b
        FROM (SELECT p.file_id, position, metadata_row, matched_ids, k, s.label_a, s.label_b,
                position = min(position) OVER (PARTITION BY p.file_id, matched_ids) AS first_of_cell
            FROM placed p JOIN (SELECT file_id, count(DISTINCT (label_a, label_b)) AS k,
                first(label_a {_ORDERED}) AS label_a, first(label_b {_ORDERED}) AS label_b
                FROM matches GROUP BY file_id HAVING count(*) > 1) s ON p.file_id = s.file_id)
        GROUP BY file_id""",
        "matches",
        placed=_PLACED,
    ),
    "array_layout": DATASET_ORACLES["stratified_split"],
    "csv_encodings": """SELECT doc_id, substr(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ, ]', '', 'g'), 1, 80) AS note, true AS numbered
        FROM documents""",
    "ratio_sketch": with_views(
        """SELECT count(*) AS n, round(min(r), 9) AS min, round(max(r), 9) AS max, true AS median_within_bound
        FROM (SELECT length(out)::DOUBLE / greatest(length(src), 1)::DOUBLE AS r FROM pairs)""",
        "pairs",
    ),
    "pending_ledger": DATASET_ORACLES["pending_rows"],
    "stored_flags": with_views(
        f"""SELECT file_id, array_to_string(flags, ',') AS flags, CASE WHEN len(hard) > 0 THEN array_to_string(hard, ',') END AS hard_flags
        FROM (SELECT file_id, flags, list_filter(flags, lambda f: string_split(f, '(')[1] IN {_HARD_KINDS}) AS hard FROM (
            SELECT file_id, CASE WHEN file_id % 3 <> 0 THEN flags
                WHEN length(src) % 2 = 0 THEN ['placeholder(1->0)', 'too_long(2.60)'] ELSE ['script_residue(0.20)'] END AS flags
            FROM checked))""",
        "pairs",
        worded=_WORDED,
        measured=_MEASURED,
        checked=_CHECKED,
    ),
    "upsert_in_place": DATASET_ORACLES["upsert_pairs"],
    "split_from_counts": DATASET_ORACLES["stratified_split"],
    "label_tree": with_views(
        """SELECT file_id, task, label AS left_label, (SELECT count(*) FROM last_labels) AS n_left,
            (SELECT count(*) FROM last_labels WHERE task <> 'error' OR label = 0) AS n_right
        FROM last_labels WHERE task = 'error' AND label <> 0""",
        "last_labels",
    ),
}

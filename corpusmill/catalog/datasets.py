"""Queries on task datasets, splits, label merging and text pairs of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.matching import _usable
from corpusmill.catalog.views import GROUPS, LABELS, QUESTIONS, SEED, TEST_SIZE, with_views
from corpusmill.operators import datasets, guards, merging, pairs
from corpusmill.plans.materialize import materialize, scratch_path
from corpusmill.plans.split import stratified_split
from corpusmill.sources.datasets import read_tasks, write_tasks

PARALLEL_GROUPS = {"any": ("quality", "toxic")}


def _labels(spark, d):
    """One label per ID and task, written once: the split reads it three times."""
    return materialize(merging.last_labels(v.task_labels(spark, d)))


def _split(spark, d):
    return stratified_split(_labels(spark, d), ["task"], "label", "file_id", TEST_SIZE, SEED)


def document_splits(spark, d):
    labels = v.long_labels(spark, d)
    return stratified_split(labels, ["task"], "label", "file_id", TEST_SIZE, SEED)


def train_labels(spark, d):
    return document_splits(spark, d).where("split = 'train'")


def _excluded(spark, d):
    return merging.last_labels(v.task_labels(spark, d)).where("task = 'error' and label = 1").select("file_id")


def _merged_split(spark, d):
    merged = merging.merge_labels(merging.exclude_ids(_labels(spark, d), _excluded(spark, d)), GROUPS)
    kept = materialize(merging.determined(merged))
    return stratified_split(kept, ["merged_task"], "label", "file_id", TEST_SIZE, SEED)


def binary_label_rows(spark, d):
    return datasets.binary_label_rows(_usable(spark, d), LABELS, ["file_id", "text_file"])


def task_records(spark, d):
    records = datasets.task_records(_usable(spark, d), LABELS, v.corpus(spark, d))
    return records.withColumn("text", F.md5("text"))


def instruction_records(spark, d):
    records = datasets.task_records(_usable(spark, d), LABELS, v.corpus(spark, d))
    return datasets.to_instruction(records, QUESTIONS).withColumn("input", F.md5("input"))


def task_dataset_layout(spark, d):
    path = scratch_path(spark, "tasks")
    write_tasks(_split(spark, d), path)
    train = read_tasks(spark, path).where("split = 'train'")
    return train.select("file_id", F.col("task").cast("string"), F.col("split").cast("string"), "label")


def split_manifest(spark, d):
    return merging.split_manifest(_merged_split(spark, d), test_size=TEST_SIZE, seed=SEED)


def split_overlap(spark, d):
    """Splits drawn per event instead of per ID, which the guard has to notice."""
    rows = stratified_split(v.task_labels(spark, d), ["task"], "label", "seq", TEST_SIZE, SEED)
    return guards.split_overlap(rows)


def label_map_diff(spark, d):
    rows = v.task_labels(spark, d)
    first = rows.groupBy("file_id", "task").agg(F.min_by("label", "seq").alias("label"))
    return guards.label_map_diff(first, merging.last_labels(rows))


def text_conflicts(spark, d):
    return guards.text_conflicts(v.table(spark, d, "documents").withColumnRenamed("source", "file_id"))


def unique_texts(spark, d):
    rows = v.table(spark, d, "documents").selectExpr(
        "source as file_id", "lang as task", "if(doc_id % 5 = 0, 'test', 'train') as split", "doc_id", "text"
    )
    return pairs.unique_texts(rows, line="doc_id").select("file_id", F.md5("text").alias("text"))


def dedupe_policies(spark, d):
    rows = v.task_labels(spark, d)
    keys = ["file_id", "task"]
    first = pairs.keep_first(rows, keys, "seq").select(*keys, F.col("seq").alias("first_seq"), F.col("label").alias("first_label"))
    last = pairs.keep_last(rows, keys, "seq").select(*keys, F.col("seq").alias("last_seq"), F.col("label").alias("last_label"))
    return first.join(last, keys)


def upsert_pairs(spark, d):
    docs = v.table(spark, d, "documents").select(
        F.col("source").alias("file_id"), F.col("doc_id").alias("seq"), "lang", F.md5("text").alias("out")
    )
    stored = docs.drop("lang")
    redone = docs.where("lang = 'fr'").drop("lang")
    fresh = docs.select(F.concat(F.lit("lang-"), "lang").alias("file_id"), "seq", "out")
    return pairs.upsert_pairs(stored, redone.unionByName(fresh))


def pending_rows(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.md5("text").alias("text"))
    done = v.table(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    return pairs.pending(docs, done)


def swap_text(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    rows = v.long_labels(spark, d).join(docs, "file_id")
    return pairs.swap_text(rows, v.translations(spark, d)).withColumn("text", F.md5("text"))


def parallel_corpora(spark, d):
    """Documents and their successors as two languages with one merged label and one split."""
    merged = merging.determined(merging.merge_labels(v.long_labels(spark, d), PARALLEL_GROUPS))
    pairs_ = v.translations(spark, d)
    covered = materialize(merged.withColumnRenamed("merged_task", "task").join(pairs_.select("file_id"), "file_id"))
    assigned = stratified_split(covered, ["task"], "label", "file_id", TEST_SIZE, SEED)
    texts = pairs_.select(
        "file_id",
        F.inline(
            F.array(
                F.struct(F.lit("first").alias("language"), F.col("src").alias("text")),
                F.struct(F.lit("second").alias("language"), F.col("out").alias("text")),
            )
        ),
    )
    made = datasets.parallel_datasets(assigned, texts, {"any": "Is either property there?"})
    return made.withColumn("input", F.md5("input"))


QUERIES = {
    "parallel_corpora": parallel_corpora,
    "binary_label_rows": binary_label_rows,
    "task_records": task_records,
    "instruction_records": instruction_records,
    "stratified_split": _split,
    "split_report": lambda s, d: datasets.split_report(_split(s, d)),
    "class_weights": lambda s, d: datasets.class_weights(merging.last_labels(v.task_labels(s, d))),
    "positive_weight": lambda s, d: datasets.positive_weight(
        merging.last_labels(v.task_labels(s, d)), alpha=0.5, cap=1.5
    ),
    "task_dataset_layout": task_dataset_layout,
    "merged_labels": lambda s, d: merging.determined(
        merging.merge_labels(merging.last_labels(v.task_labels(s, d)), GROUPS)
    ),
    "merged_counts": lambda s, d: merging.merged_counts(
        merging.last_labels(v.task_labels(s, d)), GROUPS, _excluded(s, d)
    ),
    "exclude_ids": lambda s, d: merging.exclude_ids(merging.last_labels(v.task_labels(s, d)), _excluded(s, d)),
    "split_manifest": split_manifest,
    "split_overlap": split_overlap,
    "cross_task_leak": lambda s, d: guards.cross_task_leak(_split(s, d)),
    "label_map_diff": label_map_diff,
    "text_conflicts": text_conflicts,
    "unique_texts": unique_texts,
    "dedupe_policies": dedupe_policies,
    "upsert_pairs": upsert_pairs,
    "pending_rows": pending_rows,
    "swap_text": swap_text,
}


def split_sql(source: str, group: str = "task", id_col: str = "file_id") -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {group}, label
            ORDER BY md5(concat('{SEED}|', CAST({id_col} AS VARCHAR)))) <= n_test THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, round_even(CAST(count(*) OVER (PARTITION BY {group}, label) * {TEST_SIZE} AS DOUBLE), 0) AS n_test
            FROM {source})"""


_BINARY = """SELECT file_id, text_file, task, CASE cell WHEN 'TRUE' THEN 1 ELSE 0 END AS label, cell AS label_text
    FROM (SELECT file_id, text_file, 'label_a' AS task, upper(trim(label_a)) AS cell FROM usable
        UNION ALL SELECT file_id, text_file, 'label_b', upper(trim(label_b)) FROM usable) WHERE cell IN ('TRUE', 'FALSE')"""
_MERGED = """SELECT merged_task, file_id, count(*) AS n_present,
        CASE WHEN max(label) = 1 THEN 1 WHEN count(*) = max(k) THEN 0 END AS label
    FROM (SELECT CASE WHEN task IN ('view', 'click') THEN 'med' ELSE 'high' END AS merged_task,
        CASE WHEN task IN ('view', 'click') THEN 2 ELSE 3 END AS k, file_id, label FROM {source})
    GROUP BY merged_task, file_id"""
_EXCLUDED = "SELECT file_id FROM last_labels WHERE task = 'error' AND label = 1"
_COUNTS = """SELECT task, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos
    FROM last_labels GROUP BY task"""

ORACLES = {
    "parallel_corpora": with_views(
        """SELECT s.file_id, task, concat('Is either property there?', chr(10), 'Answer with exactly one word: Yes or No.') AS instruction,
            md5(text) AS input, CASE label WHEN 1 THEN 'Yes' ELSE 'No' END AS output, label, language, split
        FROM splits s JOIN (SELECT file_id, 'first' AS language, src AS text FROM pairs
            UNION ALL SELECT file_id, 'second', out FROM pairs) t ON s.file_id = t.file_id""",
        "pairs",
        merged="""SELECT doc_id AS file_id, 'any' AS task, CASE WHEN quality = 1 OR toxic = 1 THEN 1 WHEN quality = 0 AND toxic = 0 THEN 0 END AS label
            FROM labels WHERE doc_id IN (SELECT file_id FROM pairs)""",
        known="SELECT * FROM merged WHERE label IS NOT NULL",
        splits=split_sql("known"),
    ),
    "binary_label_rows": with_views("SELECT * FROM binaries", "usable", binaries=_BINARY),
    "task_records": with_views(
        "SELECT b.*, md5(c.text) AS text FROM binaries b JOIN corpus c ON b.text_file = c.text_file",
        "usable",
        "corpus",
        binaries=_BINARY,
    ),
    "instruction_records": with_views(
        """SELECT file_id, task, concat('Does the text show property ', upper(right(task, 1)), '?', chr(10),
                'Answer with exactly one word: Yes or No.') AS instruction, md5(c.text) AS input,
            CASE label WHEN 1 THEN 'Yes' ELSE 'No' END AS output, label
        FROM binaries b JOIN corpus c ON b.text_file = c.text_file""",
        "usable",
        "corpus",
        binaries=_BINARY,
    ),
    "stratified_split": with_views(
        "SELECT file_id, task, label, split FROM splits", "last_labels", splits=split_sql("last_labels")
    ),
    "split_report": with_views(
        """SELECT task, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
            CAST(count(*) - sum(label) AS BIGINT) AS n_neg, CAST(sum(label) AS DOUBLE) / count(*) AS pos_share
        FROM splits GROUP BY task, split""",
        "last_labels",
        splits=split_sql("last_labels"),
    ),
    "class_weights": with_views(
        """SELECT task, n_neg, n_pos, (greatest(n_neg, 1) + greatest(n_pos, 1)) / (2.0::DOUBLE * greatest(n_neg, 1)) AS weight_neg,
            (greatest(n_neg, 1) + greatest(n_pos, 1)) / (2.0::DOUBLE * greatest(n_pos, 1)) AS weight_pos FROM counts""",
        "last_labels",
        counts=_COUNTS,
    ),
    "positive_weight": with_views(
        """SELECT task, n_neg, n_pos, CASE WHEN n_neg > 0 AND n_pos > 0
            THEN least(pow(n_neg::DOUBLE / n_pos::DOUBLE, 0.5::DOUBLE), 1.5::DOUBLE) ELSE 1.0::DOUBLE END AS pos_weight FROM counts""",
        "last_labels",
        counts=_COUNTS,
    ),
    "task_dataset_layout": with_views(
        "SELECT file_id, task, split, label FROM splits WHERE split = 'train'",
        "last_labels",
        splits=split_sql("last_labels"),
    ),
    "merged_labels": with_views(
        "SELECT * FROM merged WHERE label IS NOT NULL", "last_labels", merged=_MERGED.format(source="last_labels")
    ),
    "merged_counts": with_views(
        """SELECT merged_task, count(*) FILTER (NOT gone AND label IS NOT NULL) AS n_kept,
            count(*) FILTER (NOT gone AND label IS NULL) AS n_dropped_undetermined,
            count(*) FILTER (gone) AS n_excluded, count(*) FILTER (NOT gone AND label = 1) AS n_pos
        FROM (SELECT *, file_id IN (SELECT file_id FROM gone_ids) AS gone FROM merged) GROUP BY merged_task""",
        "last_labels",
        merged=_MERGED.format(source="last_labels"),
        gone_ids=_EXCLUDED,
    ),
    "exclude_ids": with_views(
        "SELECT * FROM last_labels WHERE file_id NOT IN (SELECT file_id FROM gone_ids)",
        "last_labels",
        gone_ids=_EXCLUDED,
    ),
    "split_manifest": with_views(
        f"""SELECT merged_task, split, row_number() OVER (PARTITION BY merged_task, split ORDER BY file_id) - 1 AS position,
            file_id, count(*) OVER (PARTITION BY merged_task, split) AS n_ids,
            CAST({TEST_SIZE} AS DOUBLE) AS test_size, {SEED} AS seed FROM splits""",
        "last_labels",
        gone_ids=_EXCLUDED,
        remaining="SELECT * FROM last_labels WHERE file_id NOT IN (SELECT file_id FROM gone_ids)",
        merged=_MERGED.format(source="remaining"),
        known="SELECT * FROM merged WHERE label IS NOT NULL",
        splits=split_sql("known", "merged_task"),
    ),
    "split_overlap": with_views(
        """SELECT task, file_id FROM splits WHERE split = 'train'
        INTERSECT SELECT task, file_id FROM splits WHERE split = 'test'""",
        "task_labels",
        splits=split_sql("task_labels", id_col="seq"),
    ),
    "cross_task_leak": with_views(
        """SELECT file_id, string_agg(DISTINCT task, ',' ORDER BY task) FILTER (split = 'train') AS train_tasks,
            string_agg(DISTINCT task, ',' ORDER BY task) FILTER (split = 'test') AS test_tasks
        FROM splits GROUP BY file_id HAVING count(DISTINCT split) = 2 AND count(DISTINCT task) > 1""",
        "last_labels",
        splits=split_sql("last_labels"),
    ),
    "label_map_diff": with_views(
        """SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.task, b.task) AS task,
            a.label AS left_label, b.label AS right_label
        FROM (SELECT file_id, task, arg_min(label, seq) AS label FROM task_labels GROUP BY ALL) a
        FULL JOIN last_labels b ON a.file_id = b.file_id AND a.task = b.task WHERE a.label IS DISTINCT FROM b.label""",
        "last_labels",
    ),
    "text_conflicts": """SELECT source AS file_id, count(DISTINCT text) AS n_texts FROM documents
        GROUP BY source HAVING count(DISTINCT text) > 1""",
    "unique_texts": """SELECT source AS file_id, md5(text) AS text FROM documents QUALIFY row_number() OVER
        (PARTITION BY source ORDER BY lang, doc_id % 5 = 0, doc_id) = 1""",
    "dedupe_policies": with_views(
        """SELECT file_id, task, min(seq) AS first_seq, arg_min(label, seq) AS first_label,
            max(seq) AS last_seq, arg_max(label, seq) AS last_label FROM task_labels GROUP BY file_id, task""",
        "task_labels",
    ),
    "upsert_pairs": """WITH docs AS (SELECT source AS file_id, doc_id AS seq, lang, md5(text) AS out FROM documents),
        old AS (SELECT file_id, min(seq) AS seq, arg_min(out, seq) AS out FROM docs GROUP BY file_id),
        fresh AS (SELECT file_id, max(seq) AS seq, arg_max(out, seq) AS out FROM docs WHERE lang = 'fr' GROUP BY file_id
            UNION ALL SELECT concat('lang-', lang), max(seq), arg_max(out, seq) FROM docs GROUP BY lang)
        SELECT coalesce(o.file_id, f.file_id) AS file_id, coalesce(o.seq, f.seq) AS seq, o.file_id IS NULL AS appended,
            f.file_id IS NOT NULL AS replaced, coalesce(f.out, o.out) AS out
        FROM old o FULL JOIN fresh f ON o.file_id = f.file_id""",
    "pending_rows": """SELECT doc_id AS file_id, md5(text) AS text FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "swap_text": with_views(
        "SELECT l.file_id, l.task, l.label, md5(p.out) AS text FROM long_labels l JOIN pairs p ON l.file_id = p.file_id",
        "long_labels",
        "pairs",
    ),
}

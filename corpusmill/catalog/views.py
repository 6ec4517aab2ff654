"""Inputs of the registered queries, derived from whole driver tables.

Each view exists twice, as DataFrame code and as DuckDB text, so that both engines
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.quality import QualityRules
from corpusmill.operators.matching import with_file_id
from corpusmill.plans.spread import spread

SUFFIX = "_output_transcription_output_deidentified.txt"
LABELS = ("label_a", "label_b")
GROUPS = {"med": ("view", "click"), "high": ("signup", "purchase", "error")}
QUESTIONS = {
    "label_a": "Does the text show property A?",
    "label_b": "Does the text show property B?",
}
SEED = 42
TEST_SIZE = 0.2

# The documents are in Latin script; accented letters stand for a foreign script, a
# common word for the placeholder and the refusal phrases.
RULES = QualityRules(
    script_ranges=r"\x{00C0}-\x{024F}", placeholder="que", refusal_phrases=("the", "de la", "und der")
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity"
    )
    return spread(items, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def text_file_name() -> F.Column:
    return F.expr(
        f"""concat('2024_', o_custkey, '_a1_', if(o_orderkey % 50 = 0, 'x', ''), o_orderkey,
            if(o_orderkey % 3 = 0, '.txt', '{SUFFIX}'))"""
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(text_file_name().alias("text_file"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_file_id(file_names(spark, sf_dir), SUFFIX)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metadata rows; the row number is made from the row's content, not by a sort."""
    return metadata_of(line_items(spark, sf_dir))


def metadata_of(items: DataFrame) -> DataFrame:
    return items.selectExpr(
        """cast(conv(substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            cast(round(l_extendedprice * 100) as bigint))), 1, 15), 16, 10) as bigint) as metadata_row""",
        """concat(l_orderkey, if(l_linenumber % 4 = 0, '.0', ''),
            if(l_orderkey % 10 = 3 and l_linenumber = 1, concat(', ', l_orderkey + 1), ''),
            if(l_linenumber % 5 = 0, ',n/a', '')) as matched_ids""",
        """case l_orderkey % 4 when 0 then 'TRUE' when 1 then 'FALSE'
            when 2 then 'does_not_apply' else '' end as label_a""",
        "if(l_returnflag = 'A' and l_quantity > 45, ' TRUE', 'FALSE') as label_b",
    )


def task_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat(user_id, '-', cast(ts as date)) as file_id",
        "event_type as task",
        "event_id as seq",
        "if(value > 15, 1, 0) as label",
    )


def long_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two true labels of documents in long form."""
    labels = table(spark, sf_dir, "labels")
    return labels.unpivot(["doc_id"], ["quality", "toxic"], "task", "label").withColumnRenamed("doc_id", "file_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_labels(spark, sf_dir).selectExpr(
        "concat('run', file_id % 3) as run",
        "task",
        "file_id",
        "label as y_true",
        """if(file_id % 97 = 5 and file_id % 3 = 2, cast(null as double),
            cast((file_id * 7919) % 101 as double) / 100) as p_yes""",
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a free-text answer."""
    return predictions(spark, sf_dir).withColumn(
        "raw_output",
        F.expr(
            """case file_id % 7 when 0 then 'Yes.' when 1 then ' no, not at all' when 2 then 'Well, TRUE'
            when 3 then 'nothing to see' when 4 then 'perhaps' when 5 then 'yesterday' else '0' end"""
        ),
    )


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the next document for each document; the first one follows the last."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ring = table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).first()[0] or 1
    return docs.select(F.pmod(F.col("doc_id") - 1, F.lit(ring)).alias("doc_id"), F.col("text").alias("out"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its successor as its counterpart."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    joined = docs.join(successors(spark, sf_dir), "doc_id")
    return joined.select(F.col("doc_id").alias("file_id"), F.col("text").alias("src"), "out")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each file name: orders take the document of their number modulo the document count."""
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.count("*")).first()[0]
    names = table(spark, sf_dir, "orders").select(
        text_file_name().alias("text_file"), (F.col("o_orderkey") % n_docs).alias("doc_id")
    )
    return names.join(docs.select("doc_id", "text"), "doc_id").select("text_file", "text")


SQL: dict[str, str] = {
    "text_file_names": f"""SELECT o_orderkey, concat('2024_', CAST(o_custkey AS VARCHAR), '_a1_',
        CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE '' END, CAST(o_orderkey AS VARCHAR),
        CASE WHEN o_orderkey % 3 = 0 THEN '.txt' ELSE '{SUFFIX}' END) AS text_file FROM orders""",
    "files": f"""SELECT text_file, regexp_extract(trim(split_part(prefix, '_', -1)), '^([0-9]+)(\\.0+)?$', 1) AS file_id
        FROM (SELECT text_file, CASE WHEN ends_with(text_file, '{SUFFIX}')
            THEN left(text_file, length(text_file) - {len(SUFFIX)})
            ELSE regexp_replace(text_file, '^(.+)\\.[^.]+$', '\\1') END AS prefix FROM text_file_names)""",
    "meta": """SELECT CAST(('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
            CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))), 1, 15)) AS BIGINT) AS metadata_row,
        concat(CAST(l_orderkey AS VARCHAR), CASE WHEN l_linenumber % 4 = 0 THEN '.0' ELSE '' END,
            CASE WHEN l_orderkey % 10 = 3 AND l_linenumber = 1 THEN concat(', ', CAST(l_orderkey + 1 AS VARCHAR)) ELSE '' END,
            CASE WHEN l_linenumber % 5 = 0 THEN ',n/a' ELSE '' END) AS matched_ids,
        CASE l_orderkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'does_not_apply' ELSE '' END AS label_a,
        CASE WHEN l_returnflag = 'A' AND l_quantity > 45 THEN ' TRUE' ELSE 'FALSE' END AS label_b FROM lineitem""",
    "ids": """SELECT * FROM (SELECT metadata_row, matched_ids, label_a, label_b,
            regexp_extract(trim(token), '^([0-9]+)(\\.0+)?$', 1) AS file_id
        FROM (SELECT *, unnest(string_split(matched_ids, ',')) AS token FROM meta)) WHERE file_id <> ''""",
    "matches": "SELECT f.text_file, f.file_id, i.metadata_row, i.matched_ids, i.label_a, i.label_b "
    "FROM files f JOIN ids i ON f.file_id = i.file_id",
    "agreed": """SELECT file_id, count(*) AS n_metadata_rows, count(DISTINCT (trim(label_a), trim(label_b))) AS k,
        min(trim(label_a)) AS label_a, min(trim(label_b)) AS label_b FROM ids GROUP BY file_id""",
    "usable": """SELECT f.text_file, f.file_id, n_metadata_rows,
        CASE WHEN n_metadata_rows = 1 THEN 'single_row' ELSE 'multi_row_identical' END AS match_type, label_a, label_b
        FROM files f JOIN agreed a ON f.file_id = a.file_id WHERE k = 1""",
    "task_labels": """SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS file_id,
        event_type AS task, event_id AS seq, CASE WHEN value > 15 THEN 1 ELSE 0 END AS label FROM events""",
    "last_labels": "SELECT file_id, task, arg_max(label, seq) AS label FROM task_labels GROUP BY file_id, task",
    "long_labels": """SELECT doc_id AS file_id, 'quality' AS task, quality AS label FROM labels
        UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
    "preds": """SELECT concat('run', CAST(file_id % 3 AS VARCHAR)) AS run, task, file_id, label AS y_true,
        CASE WHEN file_id % 97 = 5 AND file_id % 3 = 2 THEN NULL
            ELSE CAST((file_id * 7919) % 101 AS DOUBLE) / 100 END AS p_yes FROM long_labels""",
    "answered": """SELECT *, CASE file_id % 7 WHEN 0 THEN 'Yes.' WHEN 1 THEN ' no, not at all' WHEN 2 THEN 'Well, TRUE'
        WHEN 3 THEN 'nothing to see' WHEN 4 THEN 'perhaps' WHEN 5 THEN 'yesterday' ELSE '0' END AS raw_output,
        CASE file_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN NULL
            WHEN 5 THEN 1 ELSE 0 END AS parsed FROM preds""",
    "pairs": "SELECT s.doc_id AS file_id, s.text AS src, o.text AS out "
    "FROM documents s JOIN documents o ON o.doc_id = (s.doc_id + 1) % (SELECT max(doc_id) + 1 FROM documents)",
    "corpus": """SELECT n.text_file, d.text FROM text_file_names n
        JOIN documents d ON d.doc_id = n.o_orderkey % (SELECT count(*) FROM documents)""",
}

# What each view reads, in an order in which they can be stated.
NEEDS: dict[str, tuple[str, ...]] = {
    "files": ("text_file_names",),
    "ids": ("meta",),
    "matches": ("files", "ids"),
    "agreed": ("ids",),
    "usable": ("files", "agreed"),
    "last_labels": ("task_labels",),
    "preds": ("long_labels",),
    "answered": ("preds",),
    "corpus": ("text_file_names",),
}


def with_views(query: str, *names: str, **more: str) -> str:
    """DuckDB text of ``query`` with the views it names, and ``more`` of its own."""
    stated: dict[str, str] = {}

    def state(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            state(needed)
        stated.setdefault(name, SQL[name])

    for name in names:
        state(name)
    stated.update(more)
    clauses = ",\n".join(f"{name} AS ({text})" for name, text in stated.items())
    return f"WITH {clauses}\n{query}"

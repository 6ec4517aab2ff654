"""Queries on text pairs, words, windows and chat prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import views as v
from corpusmill.catalog.views import RULES, with_views
from corpusmill.functions.labels import parse_answer
from corpusmill.functions.quality import looping_ratio, script_ratio
from corpusmill.functions.text import SPACE_CLASS, truncate_words
from corpusmill.operators import chat, guards, models, quality


def _checked(spark, d):
    return quality.check_pairs(v.translations(spark, d), rules=RULES)


def _documents(spark, d):
    return v.documents(spark, d).select(F.col("doc_id").alias("file_id"), "text")


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


def pair_quality(spark, d):
    return _checked(spark, d).select(
        "file_id",
        _joined("flags"),
        "len_ratio",
        "residue_ratio",
        "marks_src",
        "marks_out",
        F.round("src_loop", 9).alias("src_loop"),
        F.round("out_loop", 9).alias("out_loop"),
    )


def hard_flag_rows(spark, d):
    return quality.damaged(_checked(spark, d)).select("file_id", _joined("flags"), _joined("hard_flags"))


def redo_candidates(spark, d):
    stored = v.translations(spark, d).select("file_id", "out")
    redo = quality.redo_candidates(stored, _documents(spark, d), rules=RULES)
    return redo.select("file_id", _joined("hard_flags"), "len_ratio")


def missing_pairs(spark, d):
    sound = _checked(spark, d).where(F.size("flags") == 0)
    return guards.missing_pairs(v.long_labels(spark, d), sound)


def flag_rate_by_label(spark, d):
    rates = quality.flag_rate_by_label(_checked(spark, d), v.long_labels(spark, d))
    return rates.withColumn("flag_rate", F.round("flag_rate", 9))


def parse_answers(spark, d):
    answers = v.answered(spark, d).select("raw_output").unionByName(
        v.table(spark, d, "conversations").select(F.col("text").alias("raw_output"))
    )
    return answers.select(F.md5("raw_output").alias("answer"), parse_answer("raw_output").alias("label"))


def truncated(spark, d):
    docs = _documents(spark, d)
    return docs.select(
        "file_id",
        F.md5(truncate_words("text", 200, "head")).alias("head"),
        F.md5(truncate_words("text", 200, "tail")).alias("tail"),
    )


def chunked(spark, d):
    chunks = models.chunk_rows(_documents(spark, d), max_length=128, max_chunks=6, side="tail")
    return chunks.select(
        "file_id", "chunk_no", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens")
    )


def mean_pool(spark, d):
    pooled = models.mean_pool(v.table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("position", "value")).withColumn(
        "value", F.round("value", 6)
    )


def chat_prompts(spark, d):
    return chat.render_chat(v.table(spark, d, "conversations"), eos="</s>", add_generation_prompt=True)


def chat_messages(spark, d):
    """Prompts of single examples: system, instruction and text from one row."""
    system, question = "You are a careful annotator.", F.lit("Does the text show property A?")
    rows = _documents(spark, d)
    prompt = chat.render_messages(chat.to_messages(question, "text", system), "</s>", True)
    return rows.select("file_id", F.md5(prompt).alias("prompt"))


QUERIES = {
    "script_ratio": lambda s, d: _documents(s, d).select(
        "file_id", F.round(script_ratio("text", RULES.script_ranges), 9).alias("ratio")
    ),
    "looping_ratio": lambda s, d: _documents(s, d).select(
        "file_id", F.round(looping_ratio("text"), 9).alias("ratio")
    ),
    "pair_quality": pair_quality,
    "hard_flag_rows": hard_flag_rows,
    "redo_candidates": redo_candidates,
    "flag_counts": lambda s, d: quality.flag_counts(_checked(s, d)),
    "flag_rate_by_label": flag_rate_by_label,
    "ratio_stats": lambda s, d: quality.ratio_stats(_checked(s, d)),
    "flagged_preview": lambda s, d: quality.flagged_preview(_checked(s, d), 20).withColumn("flags", F.array_join("flags", ",")),
    "missing_pairs": missing_pairs,
    "parse_answer": parse_answers,
    "truncate_tokens": truncated,
    "chunk_tokens": chunked,
    "mean_pool": mean_pool,
    "render_chat": chat_prompts,
    "render_messages": chat_messages,
}

# Words of a text, and the share of looping windows, for DuckDB.
def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE_CLASS}]+'), lambda w: w <> '')"


_LOOP = """CASE WHEN len({w}) <= 40 THEN 0.0::DOUBLE ELSE
    len(list_filter(range(0, len({w}) - 40, 20), lambda i: len(list_distinct({w}[i + 1 : i + 40])) / 40.0::DOUBLE < 0.3::DOUBLE))::DOUBLE
    / len(range(0, len({w}) - 40, 20))::DOUBLE END"""
_LETTERS = r"'[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]'"


def _share(text: str) -> str:
    return f"""CASE WHEN len(regexp_extract_all({text}, '\\p{{L}}')) = 0 THEN 0.0::DOUBLE ELSE
        len(regexp_extract_all({text}, {_LETTERS}))::DOUBLE / len(regexp_extract_all({text}, '\\p{{L}}'))::DOUBLE END"""


_WORDED = f"""SELECT *, {_words('lower(src)')} AS src_words, {_words('lower(out)')} AS out_words FROM pairs"""
_MEASURED = f"""SELECT file_id, src, out, trim(out, chr(9) || chr(10) || chr(13) || ' ') = '' AS is_empty,
    length(out)::DOUBLE / greatest(length(src), 1)::DOUBLE AS ratio, {_share('out')} AS residue,
    {_LOOP.format(w='src_words')} AS src_loop, {_LOOP.format(w='out_words')} AS out_loop,
    CAST((length(src) - length(replace(src, 'que', ''))) // 3 AS INTEGER) AS marks_src,
    CAST((length(out) - length(replace(out, 'que', ''))) // 3 AS INTEGER) AS marks_out,
    regexp_matches(substr(out, 1, 400), '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(the|de la|und der)') AS phrase
    FROM worded"""
_CHECKED = """SELECT file_id, src, out, src_loop, out_loop, marks_src, marks_out,
    CAST(format('{:.3f}', ratio) AS DOUBLE) AS len_ratio, CAST(format('{:.3f}', residue) AS DOUBLE) AS residue_ratio,
    CASE WHEN is_empty THEN ['empty'] ELSE list_filter([
        CASE WHEN phrase AND ratio < 0.9::DOUBLE THEN 'refusal' END,
        CASE WHEN ratio < 0.55::DOUBLE THEN 'too_short' WHEN ratio > 2.5::DOUBLE THEN 'too_long' END,
        CASE WHEN residue > 0.1::DOUBLE THEN 'script_residue' END,
        CASE WHEN out_loop > 0.15::DOUBLE AND out_loop > src_loop + 0.15::DOUBLE THEN 'degenerate' END,
        CASE WHEN marks_src <> marks_out THEN 'placeholder' END], lambda f: f IS NOT NULL) END AS flags FROM measured"""
_HARD = "list_filter(flags, lambda f: f IN ('empty', 'refusal', 'too_short', 'script_residue', 'degenerate'))"


def _on_checked(query: str, *names: str) -> str:
    return with_views(query, "pairs", *names, worded=_WORDED, measured=_MEASURED, checked=_CHECKED)


ORACLES = {
    "script_ratio": f"SELECT doc_id AS file_id, round({_share('text')}, 9) AS ratio FROM documents",
    "looping_ratio": f"""SELECT file_id, round({_LOOP.format(w='w')}, 9) AS ratio
        FROM (SELECT doc_id AS file_id, {_words('lower(text)')} AS w FROM documents)""",
    "pair_quality": _on_checked(
        """SELECT file_id, array_to_string(flags, ',') AS flags, len_ratio, residue_ratio, marks_src, marks_out,
            round(src_loop, 9) AS src_loop, round(out_loop, 9) AS out_loop FROM checked"""
    ),
    "hard_flag_rows": _on_checked(
        f"""SELECT file_id, array_to_string(flags, ',') AS flags, array_to_string({_HARD}, ',') AS hard_flags
        FROM checked WHERE len({_HARD}) > 0"""
    ),
    "redo_candidates": _on_checked(
        f"SELECT file_id, array_to_string({_HARD}, ',') AS hard_flags, len_ratio FROM checked WHERE len({_HARD}) > 0"
    ),
    "flag_counts": _on_checked(
        """SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN len(flags) = 0 THEN ['(clean)']
            ELSE list_append(flags, '(flagged)') END) AS kind FROM checked) GROUP BY kind"""
    ),
    "flag_rate_by_label": _on_checked(
        """SELECT task, label, count(*) AS n, count(*) FILTER (len(flags) > 0) AS n_flagged,
            round(count(*) FILTER (len(flags) > 0) / count(*)::DOUBLE, 9) AS flag_rate
        FROM long_labels l JOIN checked c ON l.file_id = c.file_id GROUP BY task, label""",
        "long_labels",
    ),
    "ratio_stats": _on_checked(
        """SELECT count(*) AS n, median(len_ratio) AS median, min(len_ratio) AS min, max(len_ratio) AS max FROM checked"""
    ),
    "flagged_preview": _on_checked(
        """SELECT file_id, array_to_string(flags, ',') AS flags, len_ratio, substr(src, 1, 900) AS src, substr(out, 1, 900) AS out
        FROM checked WHERE len(flags) > 0 ORDER BY file_id LIMIT 20"""
    ),
    "missing_pairs": _on_checked(
        """SELECT DISTINCT file_id FROM long_labels
        WHERE file_id NOT IN (SELECT file_id FROM checked WHERE len(flags) = 0)""",
        "long_labels",
    ),
    "parse_answer": with_views(
        f"""SELECT md5(raw_output) AS answer, CASE
            WHEN known IN ('yes', 'true', '1', 'positive') THEN 1 WHEN known IN ('no', 'false', '0', 'negative') THEN 0
            WHEN starts_with(text, 'yes') THEN 1 WHEN starts_with(text, 'no') THEN 0 END AS label
        FROM (SELECT raw_output, lower(regexp_replace(raw_output, '^[{SPACE_CLASS}]+', '')) AS text,
            list_filter(regexp_split_to_array(lower(raw_output), '[{SPACE_CLASS}.,]+'), lambda w: w IN
                ('yes', 'true', '1', 'positive', 'no', 'false', '0', 'negative'))[1] AS known
            FROM (SELECT raw_output FROM answered UNION ALL SELECT text FROM conversations))""",
        "answered",
    ),
    "truncate_tokens": f"""SELECT file_id, md5(CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[1:200], ' ') END) AS head,
            md5(CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[len(w) - 199 : len(w)], ' ') END) AS tail
        FROM (SELECT doc_id AS file_id, text, {_words('text')} AS w FROM documents)""",
    "chunk_tokens": f"""SELECT file_id, CAST(i - greatest(k - 6, 0) AS INTEGER) AS chunk_no,
            CAST(len(w[i * 126 + 1 : i * 126 + 126]) AS INTEGER) AS n_tokens,
            md5(coalesce(array_to_string(w[i * 126 + 1 : i * 126 + 126], ' '), '')) AS tokens
        FROM (SELECT *, unnest(range(greatest(k - 6, 0), k)) AS i FROM (SELECT *, CAST(ceil(greatest(len(w), 1) / 126.0) AS BIGINT) AS k
            FROM (SELECT doc_id AS file_id, {_words('text')} AS w FROM documents)))""",
    "mean_pool": """SELECT label, CAST(position - 1 AS INTEGER) AS position, round(avg(value), 6) AS value
        FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS position, unnest(embedding)::DOUBLE AS value FROM embeddings)
        GROUP BY label, position""",
    "render_chat": """SELECT conv_id, position, n_turns, concat(CASE role
            WHEN 'system' THEN concat('<User>: ', text, chr(10), chr(10))
            WHEN 'user' THEN concat(CASE WHEN position = 0 THEN '<User>: ' ELSE '' END, text)
            WHEN 'assistant' THEN concat(' <Assistant>: ', text, '</s>') ELSE '' END,
            CASE WHEN position = n_turns - 1 THEN ' <Assistant>:' ELSE '' END) AS prompt
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
            count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations)""",
    "render_messages": """SELECT doc_id AS file_id, md5(concat('<User>: You are a careful annotator.', chr(10), chr(10),
            'Does the text show property A?', chr(10), chr(10), text, ' <Assistant>:')) AS prompt FROM documents""",
}

"""Registered queries: each applies its operator to its whole table with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    bpe,
    exact_dedup,
    html,
    importance,
    manifest,
    minhash,
    mixing,
    quality,
    rules,
    sharding,
    token_counts,
    token_files,
    toxicity,
)
from corpusmill.llm.common import table
from corpusmill.plans.materialize import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Wanted shares of tokens: four languages of good prose and, as a class of its own, poor text.
TARGETS = {"en": 0.50, "de": 0.16, "fr": 0.16, "es": 0.12, "junk": 0.06}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op2_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = minhash.NearDuplicates(words=4, percent=80)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), settings)


PIECE_VOCABULARY = token_counts.Vocabulary(
    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
)


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op4_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.digest_rows(table(spark, sf_dir, "documents")).df
    return exact_dedup.mark_duplicates(rows, exact_dedup.DigestIndex.scratch(spark))


def op6_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


def op11_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token_files")
    docs = table(spark, sf_dir, "documents")
    return token_files.TokenFiles.write(docs, folder, BYTE_TOKENIZER, end_id=0).digests()


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = importance.Resampling(longest=2, buckets=10_000, percent=25, min_words=20, seed=7)
    return importance.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), settings)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.verify_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "manifest"), tampered)


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_minhash_odd_sketch": op2_minhash_odd_sketch,
    "op3_edit_aware_counts": op3_edit_aware_counts,
    "op4_quality_rff": op4_quality_rff,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_tag_path_text": op6_tag_path_text,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_weak_rules": op8_weak_rules,
    "op9_word_bpe": op9_word_bpe,
    "op10_rendezvous_shards": op10_rendezvous_shards,
    "op11_huffman_token_files": op11_huffman_token_files,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# CRC-32 by its table of 256 remainders, derived from the polynomial; for binary values.
CRC_TABLE = """
        crc_table AS (
          SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
            FROM range(256) r(i))
        )"""
CRC = """xor(list_reduce(
              list_transform(range(octet_length({0})), lambda j: CAST(concat('0x', substr(hex({0}), 2 * j + 1, 2)) AS BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

# DuckDB texts. White space is [\x20\x09-\x0D] throughout.
ORACLES = {
    "op5_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents
        ),
        g AS (
          SELECT text_sha256, count(*) AS group_size,
                 first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id
          FROM t GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    # CRC-32 by its table of 256 remainders, which the first clause derives from the polynomial.
    "op10_rendezvous_shards": """
        WITH crc_table AS (
          SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
            FROM range(256) r(i))
        ),
        texts AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
        hexed AS (SELECT doc_id, octet_length(raw) AS n, hex(raw) AS h FROM texts),
        sized AS (
          SELECT doc_id, n + 16 AS size, xor(list_reduce(
              list_transform(range(n), lambda j: CAST(concat('0x', substr(h, 2 * j + 1, 2)) AS BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
          FROM hexed, crc_table
        ),
        scores AS (
          SELECT doc_id, s, -1 / ln((CAST(concat('0x', substr(md5(concat(CAST(doc_id AS VARCHAR), ':', CAST(s AS VARCHAR))), 1, 12)) AS BIGINT) + 0.5) / 281474976710656) AS score
          FROM documents, range(41) r(s)
        ),
        placed AS (
          SELECT doc_id, CAST(arg_max(s, score) FILTER (s < 40) AS INTEGER) AS shard, CAST(arg_max(s, score) AS INTEGER) AS grown_shard
          FROM scores GROUP BY doc_id
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
          row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
        FROM sized JOIN placed USING (doc_id)
    """,
    # Runs are hashed once each, then counted per bucket.
    "op12_importance_resampling": rf"""
        WITH {CRC_TABLE},
        texts AS (
          SELECT doc_id AS k, true AS raw, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT item_id AS k, false AS raw, coalesce(text, '') AS text FROM benchmark
        ),
        worded AS (
          SELECT k, raw, regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM texts
        ),
        runs AS (
          SELECT k, raw, unnest(w) AS f FROM worded
          UNION ALL
          SELECT k, raw, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS f
          FROM worded WHERE len(w) > 1
        ),
        counted AS (SELECT k, raw, f, count(*) AS n FROM runs GROUP BY k, raw, f),
        spelled AS (SELECT DISTINCT f, encode(f) AS e FROM counted),
        hashed AS (SELECT f, {CRC.format("e")} % 10000 AS b FROM spelled, crc_table),
        bucketed AS (SELECT k, raw, b, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY k, raw, b),
        gains AS (
          SELECT b, CAST(floor(1000 * ln(
              CAST(coalesce(sum(n) FILTER (NOT raw), 0) + 1 AS DOUBLE) * (any_value(s) + 10000)
              / (CAST(coalesce(sum(n) FILTER (raw), 0) + 1 AS DOUBLE) * (any_value(t) + 10000)))) AS BIGINT) AS gain
          FROM bucketed, (
            SELECT CAST(coalesce(sum(n) FILTER (raw), 0) AS DOUBLE) AS s,
                   CAST(coalesce(sum(n) FILTER (NOT raw), 0) AS DOUBLE) AS t FROM bucketed)
          GROUP BY b
        ),
        weighed AS (
          SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
          FROM bucketed JOIN gains USING (b) WHERE raw GROUP BY k
        ),
        scored AS (
          SELECT k AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
              (CAST(concat('0x', substr(sha256(concat('7:', CAST(k AS VARCHAR))), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
          FROM worded LEFT JOIN weighed USING (k) WHERE raw
        ),
        ranked AS (
          SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS quota
          FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= quota THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
    # Level by level; a tree ends where one node is left. Sources are spelled so that NULL comes first.
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE {CRC_TABLE.strip()},
        spelled AS (
          SELECT doc_id, coalesce(concat('=', source), '-') AS tree, text, concat(
              coalesce(concat(octet_length(encode(CAST(doc_id AS VARCHAR))), ':', CAST(doc_id AS VARCHAR)), '-'),
              coalesce(concat(octet_length(encode(source)), ':', source), '-'),
              coalesce(concat(octet_length(encode(lang)), ':', lang), '-'),
              coalesce(concat(octet_length(encode(CAST(n_chars AS VARCHAR))), ':', CAST(n_chars AS VARCHAR)), '-')) AS head,
            encode(CAST(doc_id AS VARCHAR)) AS e
          FROM documents
        ),
        tampered AS (
          SELECT doc_id, tree, head, text, CASE WHEN {CRC.format("e")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
          FROM spelled, crc_table
        ),
        leaves AS (
          SELECT doc_id, tree,
            sha256(concat(head, coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS leaf,
            sha256(concat(head, coalesce(concat(octet_length(encode(cut)), ':', cut), '-'))) AS given
          FROM tampered
        ),
        placed AS (
          SELECT doc_id, tree, leaf, given, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
          FROM leaves
        ),
        nodes AS (
          SELECT tree, 0 AS lvl, pos, n, leaf AS d FROM placed
          UNION ALL
          SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos))
          FROM nodes WHERE n > 1 GROUP BY tree, lvl, n, pos // 3
        ),
        subroots AS (
          SELECT tree, lvl AS height, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ),
        upper AS (
          SELECT 0 AS lvl, pos, n, d FROM subroots
          UNION ALL
          SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, n, pos // 3
        ),
        -- Siblings of every step; the steps above a subroot follow those of its tree.
        lower_runs AS (
          SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS ahead,
            coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
          WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos
        ),
        upper_runs AS (
          SELECT a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS ahead,
            coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
          FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
          WHERE a.n > 1 GROUP BY a.lvl, a.pos
        ),
        climb AS (
          SELECT tree, pos AS leaf_pos, 0 AS lvl, pos, given AS d, '' AS proof FROM placed
          UNION ALL
          SELECT c.tree, leaf_pos, c.lvl + 1, c.pos // 3, sha256(concat(r.ahead, c.d, r.behind)), concat(proof, r.ahead, r.behind)
          FROM climb c JOIN lower_runs r ON c.tree = r.tree AND c.lvl = r.lvl AND c.pos = r.pos
        ),
        climb_on AS (
          SELECT c.tree, leaf_pos, 0 AS lvl, s.pos, c.d, c.proof
          FROM climb c JOIN subroots s ON c.tree = s.tree AND c.lvl = s.height
          UNION ALL
          SELECT c.tree, leaf_pos, c.lvl + 1, c.pos // 3, sha256(concat(r.ahead, c.d, r.behind)), concat(proof, r.ahead, r.behind)
          FROM climb_on c JOIN upper_runs r ON c.lvl = r.lvl AND c.pos = r.pos
        )
        SELECT p.doc_id, p.leaf, s.d AS subroot, u.d AS root, sha256(c.proof) AS proof_sha256, c.d AS folded_root, c.d = u.d AS verified
        FROM placed p JOIN subroots s USING (tree)
        JOIN (SELECT lvl, d FROM upper WHERE n = 1) u ON true
        JOIN climb_on c ON c.tree = p.tree AND c.leaf_pos = p.pos AND c.lvl = u.lvl
    """,
}

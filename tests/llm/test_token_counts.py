import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries
from corpusmill.llm import token_counts as C

PIECES = ["a", "b ", " ", "  ", "\n", "'", "r", "e", "'re", "1", "12", "é", "!", "\n\n ", "ll", "\t", "x́", "日本", "\U0001f600"]


@pytest.fixture(scope="module")
def counter():
    v = queries.PIECE_VOCABULARY
    return C.PieceCounter(open(v.path, "rb").read(), v.pattern)


def test_edits_equal_full_counts(counter):
    draw = random.Random(3)
    for _ in range(60):
        counted = C.CountedText("".join(draw.choice(PIECES) for _ in range(draw.choice([0, 1, 5, 300, 1500]))), counter)
        for _ in range(20):
            n = len(counted.text)
            a = draw.randint(0, n)
            b = min(n, a + draw.choice([0, 0, 1, 2, 5, 40, 400]))
            new = "".join(draw.choice(PIECES) for _ in range(draw.choice([0, 1, 2, 5, 30, 400])))
            expected = counted.text[:a] + new + counted.text[b:]
            counted.edit(a, b, new)
            assert counted.text == expected and counted.tree.n_chars == len(expected)
            assert counted.tree.n_tokens == len(counter.encoding.encode_ordinary(expected))


def test_an_edit_reencodes_little(counter):
    counted = C.CountedText("some words of text " * 20_000, counter)
    counted.edit(150_000, 150_004, "other")
    assert counted.reencoded < 2_000


ROWS = [(1, "It's a text, we're told. " * 40), (2, None), (3, ""), (4, "x" * 30_000), (None, "no id"), (1, "again"), (5, " \n ")]


def test_trees_then_edits(spark, make_docs, counter):
    docs = make_docs(ROWS, clash=True)
    trees = C.build_trees(docs.where("doc_id in (2, 3, 4)"), queries.PIECE_VOCABULARY)
    edits = spark.createDataFrame(
        [(4, 2, 0, 3, "new "), (4, 1, 5, 9, "it's"), (3, 1, 0, 0, "was empty"), (2, 1, -4, 90, None)],
        "doc_id bigint, seq int, start int, end int, replacement string",
    )
    rows = docs.select("doc_id", "text").join(trees, "doc_id").join(C.edits_by_document(edits), "doc_id", "left")
    found = {r.doc_id: r for r in C.apply_edits(rows, queries.PIECE_VOCABULARY).collect()}
    text = "x" * 5 + "it's" + "x" * (30_000 - 9)
    assert found[4].text == "new " + text[3:] and found[3].text == "was empty" and found[2].text == ""
    for r in found.values():
        assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) == sum(r.leaf_tokens)
        assert sum(r.leaf_chars) == len(r.text)


def check_recount(rows, texts, counter):
    for r in rows:
        text = texts[r.doc_id]
        third = len(text) // 3
        edited = text[:third] + text[third + 20 :]
        at = min(2 * third, len(edited))
        edited = edited[:at] + text[:10] + edited[at:]
        start = max(0, min(len(text) - 11, len(edited)))
        end = max(start, min(len(text) + 20, len(edited)))
        edited = edited[:start] + " we're done." + edited[end:]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(edited)) and r.n_chars_edited == len(edited)


def test_recount(make_docs, counter):
    rows = [r for r in ROWS if r != (1, "again")]
    found = C.recount(make_docs(rows, clash=True), queries.PIECE_VOCABULARY).collect()
    assert len(found) == len(rows)
    check_recount(found, {i: t or "" for i, t in rows}, counter)
    assert C.recount(make_docs([]), queries.PIECE_VOCABULARY).collect() == []


def test_query(spark, counter):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()}
    found = queries.QUERIES["op3_edit_aware_counts"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    check_recount(found, texts, counter)

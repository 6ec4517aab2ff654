import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import queries
from corpusmill.llm import toxicity as T


def brute_segments(scores):
    """Maximal segments by their definition: split at the best one, then both sides."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (found is None or total > found[2] or (total == found[2] and j + 1 - i < found[1] - found[0])):
                    found = (i, j + 1, total)
        if found is None:
            return []
        return [*best(a, found[0]), found, *best(found[1], b)]

    return best(0, len(scores))


@given(st.lists(st.sampled_from([-3.0, -1.5, -1.0, 0.7, 1.3, 2.9]), max_size=14))
def test_segments_by_definition(scores):
    found = T.maximal_segments(np.array(scores))
    assert np.isclose(sum(s for _, _, s in found), sum(s for _, _, s in brute_segments(scores)))
    for a, b, s in found:
        assert np.isclose(s, sum(scores[a:b])) and s > 0


def test_long_segments_are_linear():
    draw = np.random.default_rng(1).normal(-0.1, 1, 300_000)
    assert len(T.maximal_segments(draw)) > 1000


def fixture(n=400, toxic=0.2):
    draw = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("ata", "ono", "uru", "ere")]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(20, 80))]
        bad = draw.random() < toxic
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["vile", "nastyone", "nastytwo", "nastyabc"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows, labels = fixture()
    edges = [(None, None), (9001, ""), (9002, "nastyone nastytwo vile " * 5), (9003, "bata " * 60_000), (9002, "x")]
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, labels[5][1])], "doc_id bigint, toxic int")
    found = T.score_documents(make_docs([*rows, *edges], clash=True), marks).collect()
    assert len(found) == len(rows) + len(edges)
    truth = dict(labels)
    wrong = [r for r in found if r.doc_id in truth and r.held_out and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 3
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert next(r for r in found if r.doc_id == 9001).predicted == 0
    assert next(r for r in found if r.doc_id == 9002 and r.n_passages).predicted == 1


def test_passages_lie_on_the_words(spark, make_docs):
    rows, labels = fixture()
    model = T.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), T.key_remainder("doc_id", 3) == 1)
    text = "bata cono " * 30 + "vile NASTYONE" + " dere fata" * 30
    (row,) = T.passages(make_docs([(1, text)]), model).collect()
    (found,) = row.passages
    assert text[found.start : found.end] == "vile NASTYONE" and found.e_value < 1


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in T.score_documents(make_docs([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert T.score_documents(make_docs([]), none).collect() == []


def test_drop_agrees_with_scores(spark, make_docs):
    rows, labels = fixture()
    docs, marks = make_docs([*rows, (None, None)], clash=True), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = {r.doc_id for r in T.score_documents(docs, marks).collect() if not r.predicted}
    left = T.drop_toxic(docs, marks)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == scored


def test_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries.QUERIES["op7_toxic_segments"](spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in found)
    assert hit >= 0.85 * sum(truth[r.doc_id] for r in found)
    assert sum(r.predicted for r in found) - hit <= 0.005 * len(found)

import hashlib
import re
from collections import defaultdict

import pytest
from compare import connect, differences

from corpusmill.llm import exact_dedup as E
from corpusmill.llm import queries

ROWS = [
    (5, "a b\tc"),
    (3, "abc"),
    (9, "a  b  c"),
    (4, "a  b  c"),
    (7, None),
    (8, ""),
    (6, " \n"),
    (10, "x" * 300_000),
    (11, "é"),
    (12, "é"),
    (13, "a bc"),
    (3, "abc"),
    (None, "only here"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()].append((i, t or ""))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, best, len(members), i == best, key) for i, _ in members]
    return sorted(out, key=str)


def marks(docs, index):
    return sorted(map(tuple, E.mark_duplicates(E.digest_rows(docs).df, index).collect()), key=str)


def test_marks_equal_brute_force(spark, make_docs):
    assert marks(make_docs(ROWS, clash=True), E.DigestIndex.scratch(spark)) == brute(ROWS)


def test_second_batch_meets_the_index(spark, make_docs):
    index = E.DigestIndex.scratch(spark)
    marks(make_docs([(1, "one"), (2, "two")]), index)
    later = {r[0]: (r[1], r[3]) for r in marks(make_docs([(3, "o n e"), (4, "three"), (2, "two")]), index)}
    assert later == {3: (1, False), 4: (4, True), 2: (2, True)}
    assert index.table().count() == 3


def test_index_is_found_again_by_path(spark, make_docs):
    index = E.DigestIndex.scratch(spark)
    marks(make_docs([(1, "one")]), index)
    again = E.DigestIndex.open(spark, index.name + "_again", index.path, index.buckets)
    assert again.table().count() == 1


def test_anti_join_reads_the_index_without_shuffle(spark, make_docs):
    index = E.DigestIndex.scratch(spark)
    marks(make_docs(ROWS), index)
    groups = E.digest_groups(E.digest_rows(make_docs(ROWS)).df)
    plan = groups.hint("merge").join(index.table().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_drop_keeps_one_of_each(spark, make_docs):
    left = E.drop_exact_duplicates(make_docs(ROWS, clash=True), E.DigestIndex.scratch(spark))
    assert "_gone" in left.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 4, 6, 10, 11, 12, 13]
    repeated = E.drop_exact_duplicates(make_docs([(1, "a"), (1, "a"), (2, "b")]), E.DigestIndex.scratch(spark))
    assert sorted(r.doc_id for r in repeated.collect()) == [1, 2]


def test_empty_table(spark, make_docs):
    assert marks(make_docs([]), E.DigestIndex.scratch(spark)) == []


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_query_equals_sql(spark, scale):
    sf_dir = f"/root/testdata/{scale}"
    df = queries.QUERIES["op5_exact_dedup"](spark, sf_dir)
    assert differences(df, connect(sf_dir), queries.ORACLES["op5_exact_dedup"]) is None


def test_another_bucket_count_is_refused(spark, make_docs):
    index = E.DigestIndex.scratch(spark)
    marks(make_docs([(1, "one")]), index)
    with pytest.raises(ValueError, match="buckets"):
        E.DigestIndex.open(spark, index.name + "_other", index.path, index.buckets * 2)


def test_one_id_with_equal_texts_stays_once(spark, make_docs):
    rows = [(9, "abc"), (9, "a  b  c"), (9, "other"), (10, "a b c"), (11, "x y"), (11, "xy "), (11, "x y")]
    found = marks(make_docs(rows), E.DigestIndex.scratch(spark))
    assert sorted((r[0], r[3]) for r in found) == [(9, False), (9, True), (9, True), (10, False), (11, True), (11, True), (11, True)]
    left = E.drop_exact_duplicates(make_docs(rows), E.DigestIndex.scratch(spark)).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id == 9) == [(9, "a  b  c"), (9, "other")]
    assert [r.doc_id for r in left if r.doc_id != 9] == [11]

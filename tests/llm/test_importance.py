import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import importance
from corpusmill.llm.importance import Resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, runs


def brute_force(docs, target, wanted=Resampling()):
    def counts(texts):
        return Counter(crc32(f.encode()) % wanted.buckets for t in texts for f in features(t, wanted.longest)[1])

    s, t, b = counts(text for _, text in docs), counts(target), wanted.buckets
    big_s, big_t = s.total() + b, t.total() + b
    rows, eligible = [], []
    for doc_id, text in docs:
        words, runs = features(text, wanted.longest)
        gains = []
        for f in runs:
            k = crc32(f.encode()) % b
            gains.append(math.floor(1000 * math.log((t[k] + 1) * big_s / ((s[k] + 1) * big_t))))
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{wanted.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(runs), weight, score, None])
        if len(words) >= wanted.min_words:
            eligible.append(rows[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is not None, r[0]))
    for rank, row in enumerate(eligible[: wanted.percent * len(eligible) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


@given(st.text(st.sampled_from("aZ9 -_é漢\x00\x1c\n\x85 "), max_size=60), st.integers(1, 4), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_runs_are_those_of_the_joined_words_whatever_the_pieces(text, longest, piece):
    found = Counter()
    for _, hashes in importance.hashed_runs(text.encode(), longest, piece):
        found.update(hashes)
    assert found == Counter(crc32(f.encode()) for f in features(text, longest)[1])


LONG = " ".join(f"w{i % 97} Ünï{i % 13}" for i in range(300_000))
ROWS = [
    *[(i, " ".join(f"word{(i * k) % 37}" for k in range(10 + i))) for i in range(60)],
    (100, LONG),
    (101, "Same words here " * 10),
    (102, "Same words here " * 10),
    (103, None),
    (104, ""),
    (105, "...\n\t"),
    (None, "no id " * 15),
    (7, "id seven again " * 9),
]
TARGET = ["word3 word7 word3", None, "", "Same WORDS here"]


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, make_docs, clash):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.rank_documents(make_docs(ROWS, clash), target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(ROWS, TARGET)


def test_other_settings(spark, make_docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    wanted = Resampling(longest=3, buckets=101, percent=60, min_words=12, seed=3)
    found = importance.rank_documents(make_docs(ROWS), target, wanted)
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(ROWS, TARGET, wanted)


def test_resample_keeps_the_drawn_rows_whole(spark, make_docs):
    docs = make_docs(ROWS, clash=True)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns
    expected = [r[0] for r in brute_force(ROWS, TARGET) if r[4] is not None]
    assert sorted(r.doc_id for r in drawn.select("doc_id").collect()) == sorted(expected)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert importance.rank_documents(make_docs([]), none).collect() == []
    assert importance.resample(make_docs([]), none).collect() == []
    assert sorted(map(tuple, importance.rank_documents(make_docs(ROWS), none).collect()), key=str) == brute_force(ROWS, [])

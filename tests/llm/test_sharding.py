import hashlib
import math
import zlib
from collections import Counter

import pytest

from corpusmill.llm import sharding as S

ROWS = [(i, f"text {i}") for i in range(400)] + [(None, None), (3, "text 3"), (500, ""), (501, "é" * 100_000)]


def place(key, weights):
    scores = []
    for n, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        if w > 0:
            scores.append((-w / math.log(u), -n))
    return -max(scores)[1]


def test_rows_equal_brute_force(make_docs):
    found = S.shard_documents(make_docs(ROWS, clash=True), n_shards=7).collect()
    assert len(found) == len(ROWS)
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    for r in found:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == place(key, [1] * 7) and r.grown_shard == place(key, [1] * 8)
        assert r.grown_shard in (r.shard, 7)
    for shard in range(7):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights(make_docs):
    rows = [(i, "") for i in range(3000)]
    found = Counter(r.shard for r in S.shard_documents(make_docs(rows), weights=[1, 0, 3]).collect())
    assert set(found) == {0, 2} and 0.20 < found[0] / 3000 < 0.30


def test_bad_weights():
    with pytest.raises(ValueError):
        S.choose_shard(None, [])


def test_empty_table(make_docs):
    assert S.shard_documents(make_docs([])).collect() == []

import heapq
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import token_files
from corpusmill.llm.token_files import Codebook, TokenFiles, code_lengths
from corpusmill.plans.materialize import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


def best_limited_cost(counts, limit):
    """Least cost of lengths that a prefix code can have, by trying all non-increasing ones."""
    counts = sorted((c for c in counts if c), reverse=True)
    if len(counts) == 1:
        return counts[0]
    best = None

    def go(at, shortest, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if at == len(counts):
            best = cost
            return
        for length in range(shortest, limit + 1):
            left = room - (1 << (limit - length))
            if left >= 0:
                go(at + 1, length, left, cost + length * counts[at])

    go(0, 1, 1 << limit, 0)
    return best


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=7).filter(any), st.integers(3, 6))
@settings(max_examples=150, deadline=None)
def test_lengths_cost_least_within_the_limit(counts, limit):
    lengths = code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and [bool(x) for x in lengths] == [bool(c) for c in counts]
    assert int((lengths.astype(int) * counts).sum()) == best_limited_cost(counts, limit)


def test_lengths_equal_huffman_where_the_limit_does_not_bind():
    counts = np.random.default_rng(0).zipf(1.3, 5000).clip(max=100_000)
    assert int((code_lengths(counts, 40).astype(int) * counts).sum()) == huffman_cost(counts.tolist())


def test_the_limit_binds_on_steep_counts_and_too_many_symbols_fail():
    counts = np.array([2**k for k in range(30)])
    assert code_lengths(counts, 29).max() == 29
    lengths = code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) <= 1
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)


@given(st.integers(1, 400), st.integers(0, 1500), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_blocks_decode_whole_and_from_any_place(symbols, n, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.4, n) % symbols).astype(np.uint32)
    counts = np.bincount(ids, minlength=symbols)
    book = Codebook(code_lengths(counts, 18))
    stream, checkpoints = book.encode(ids)
    assert len(stream) == -(-int((book.lengths[ids]).sum()) // 8)
    assert np.array_equal(book.decode(stream, checkpoints, n), ids)
    for first, last in rng.integers(0, n + 2, (5, 2)):
        assert np.array_equal(book.decode(stream, checkpoints, n, first, last), ids[first:last])


def test_codes_are_canonical():
    book = Codebook(np.array([2, 0, 1, 3, 3], np.uint8))
    assert [f"{int(book.codes[s]):0{book.lengths[s]}b}" for s in (2, 0, 3, 4)] == ["0", "10", "110", "111"]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return token_files.Encoder(file.read(), 2)


TEXTS = st.one_of(st.text(max_size=60), st.text(st.sampled_from(" \t\n\x1c\x1f\x85\xa0\u200b\u2003ab'ss12é!漢"), max_size=40), st.text(st.sampled_from(" \n\nab,'sé"), max_size=30))


@given(st.lists(TEXTS, max_size=6))
@settings(max_examples=400, deadline=None)
def test_stretches_encode_as_the_whole_text(encoder, texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_caches_stay_bounded(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_STRETCHES", 5)
    encoder.young, encoder.old = {}, {}
    for i in range(50):
        texts = [f"word{i} other{i % 3} and{j}" for j in range(4)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
        assert len(encoder.young) < 30 and len(encoder.old) < 30


def brute_force(rows):
    tokenizer = Tokenizer.from_file(PATH)
    found = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found.append((doc_id is not None, doc_id, len(ids), crc32(ids.tobytes()), ids))
    found.sort(key=lambda r: r[:4])
    start, rows = 0, []
    for _, doc_id, n, crc, ids in found:
        rows.append((doc_id, start, n, crc, ids))
        start += n
    return rows


ROWS = [
    *[(997 * i % 211, f"Document {i}: " + "words and words " * (i % 29)) for i in range(200)],
    (300, "long text, ünïcode 漢字 \U0001f600 " * 40_000),
    (301, None),
    (302, ""),
    (303, "<|endoftext|> spelled out! \x00\n\n\n"),
    (304, "same"),
    (304, "same"),
    (304, "other"),
    (None, "no id"),
    (None, None),
]


@pytest.mark.parametrize("clash", [False, True])
def test_files_hold_what_the_library_gives(spark, make_docs, clash):
    files = TokenFiles.write(make_docs(ROWS, clash), scratch_path(spark, "files"), PATH, block_ids=1_000)
    expected = brute_force(ROWS)
    digests = files.digests()
    assert digests.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, digests.collect()), key=lambda r: r[1]) == [r[:4] for r in expected]
    documents = TokenFiles(spark, files.folder).documents().orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in documents] == [(r[0], r[1], r[4].tolist()) for r in expected]
    order = np.concatenate([r[4] for r in expected])
    for first, last in [(0, 10), (4_990, 5_010), (20_000, 140_000), (len(order) - 3, len(order) + 9), (7, 7)]:
        assert np.array_equal(files.ids_between(first, last), order[first:last])
    assert files.blocks().count() >= 4


def test_damage_is_found(spark, make_docs):
    files = TokenFiles.write(make_docs(ROWS[:20]), scratch_path(spark, "files"), PATH)
    folder = scratch_path(spark, "damaged")
    for kind in ("codebook", "parts"):
        spark.read.parquet(f"{files.folder}/{kind}").write.parquet(f"{folder}/{kind}")
    torn = F.concat(F.lit(b"\xff"), F.expr("substring(stream, 2)"))
    spark.read.parquet(f"{files.folder}/blocks").withColumn("stream", torn).write.parquet(f"{folder}/blocks")
    with pytest.raises(Exception, match="damaged"):
        TokenFiles(spark, folder).digests().collect()


def test_one_repeated_id_and_empty_tables(spark, make_docs):
    files = TokenFiles.write(make_docs([(i, "") for i in range(5)]), scratch_path(spark, "files"), PATH)
    crc = crc32(bytes(4))
    assert sorted(map(tuple, files.digests().collect())) == [(i, i, 1, crc) for i in range(5)]
    empty = TokenFiles.write(make_docs([]), scratch_path(spark, "files"), PATH)
    assert empty.digests().collect() == [] and empty.documents().collect() == []
    assert len(empty.ids_between(0, 5)) == 0


def test_a_hot_id_is_cut_between_files(spark, make_docs):
    rows = [(None, f"text {i % 3}") for i in range(4000)]
    files = TokenFiles.write(make_docs(rows).repartition(8), scratch_path(spark, "files"), PATH)
    found = files.digests().orderBy("start").collect()
    expected = brute_force(rows)
    assert [tuple(r) for r in found] == [r[:4] for r in expected]

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components as C
from corpusmill.llm import minhash as M
from corpusmill.llm import queries
from corpusmill.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*[w[i:] for i in range(n)]))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, roots(sets, linked)


BASE = [f"w{i}" for i in range(60)]
ROWS = [
    (10, " ".join(BASE)),
    (11, " ".join(BASE).upper().replace("W", "w")),
    (12, " ".join(["new", *BASE[1:]])),
    (13, " ".join([*BASE[:30], "mid", *BASE[31:]])),
    (14, " ".join(BASE[:20])),
    (2, "\n".join([*BASE, "tail"])),
    (20, "one two"),
    (21, "ONE two"),
    (22, "one two three"),
    (30, None),
    (31, ""),
    (32, " \t\n"),
    (40, "same word " * 20_000),
    (41, "same word " * 19_000),
    (50, "É a b c d"),
    (51, "é a b c d"),
]


def test_components_equal_brute_force(make_docs):
    settings = M.NearDuplicates(words=4)
    found = {r.doc_id: r for r in M.near_duplicates(make_docs(ROWS, clash=True), settings).collect()}
    sets, expected = brute(ROWS, 4)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_nulls_and_repeats(make_docs):
    rows = [(None, " ".join(BASE)), (1, " ".join(BASE)), (1, " ".join(BASE)), (2, " ".join(BASE))]
    found = sorted((r.doc_id or 0, r.component_id, r.kept) for r in M.near_duplicates(make_docs(rows)).collect())
    assert found == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_large_group_of_near_copies(make_docs):
    """300 texts, each another edit of one: nearly all pairs are links."""
    words = [f"x{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i % 190], f"edit{i}", *words[i % 190 + 1 :]])) for i in range(300)]
    found = M.near_duplicates(make_docs(rows)).collect()
    assert {r.component_id for r in found} == {0}


def shared_line(count):
    """Short texts around one line, each fifth a near copy of the one before it."""
    line = " ".join(f"line{i}" for i in range(24))
    own = [" ".join(f"own{i - (i % 5 == 4)}x{j}" for j in range(6 + i % 40)) for i in range(count)]
    return [(i, f"{line} {own[i]}" + " more" * (i % 5 == 4)) for i in range(count)]


@pytest.mark.parametrize("tile", [7, 1024])
def test_bucket_across_components_in_tiles(spark, make_docs, monkeypatch, tile):
    """The pairs are those of a join by bucket, which is no longer made."""
    monkeypatch.setattr(M, "TILE", tile, raising=False)
    s = M.NearDuplicates(words=4)
    M.ship_package(spark)
    reps = M.signatures(make_docs(shared_line(150)), s, "doc_id", "text").select("id", "bands", *M.SKETCHED).cache()
    members = M._bucket_members(reps).df
    assert members.groupBy("band").count().where("count > 21").count() > 0
    merged = {n: n % 6 for n in range(6, 60)}
    comps = spark.createDataFrame(list(merged.items()), "node bigint, component bigint")
    a, b = M._sides(reps, "id", *M.SKETCHED)
    shared = members.select("band", F.col("id").alias("id_a")).join(members.select("band", F.col("id").alias("id_b")), "band")
    pairs = shared.where("id_a < id_b").select("id_a", "id_b").distinct()
    close = pairs.join(a, "id_a").join(b, "id_b").where(M.sketches_close(s)).collect()
    expected = {(r.id_a, r.id_b) for r in close if merged.get(r.id_a, r.id_a) != merged.get(r.id_b, r.id_b)}
    cross = M._cross_pairs(reps, members, comps, s)
    assert "bit_count" not in cross._jdf.queryExecution().optimizedPlan().toString()
    found = [(r.a, r.b) for r in cross.collect()]
    assert expected and sorted(found) == sorted(expected)


def test_components_across_tiles(make_docs, monkeypatch):
    monkeypatch.setattr(M, "TILE", 16, raising=False)
    rows = shared_line(200)
    _, expected = brute(rows, 4)
    found = M.near_duplicates(make_docs(rows), M.NearDuplicates(words=4)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_tiles_that_several_batches_hold(rows):
    tiles = np.sort(np.random.default_rng(1).integers(-9, 9, 60))
    whole = pa.RecordBatch.from_pydict({"tile": tiles, "at": np.arange(60)})
    parts = [whole.slice(i, rows) for i in range(0, 60, rows)] + [whole.slice(0, 0)]
    found = [b.column("tile").to_pylist() for b in M._whole_tiles(iter(parts)) if b.num_rows]
    assert sum(found, []) == tiles.tolist()
    assert all(x[-1] != y[0] for x, y in zip(found, found[1:]))


def test_pairs_of_tiles(monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 10)
    tiles, (in_a, in_b) = np.repeat([-2, 5, 6], [9, 1, 20]), np.random.default_rng(2).random((2, 30)) < 0.6
    found = [list(zip(a.tolist(), b.tolist())) for a, b in M._pairs_of_tiles(tiles, in_a, in_b)]
    rows = range(30)
    assert sum(found, []) == [(i, j) for i in rows for j in rows if in_a[i] and in_b[j] and tiles[i] == tiles[j]]
    assert max(map(len, found)) <= 20


def test_drop(make_docs):
    left = M.drop_near_duplicates(make_docs(ROWS, clash=True), M.NearDuplicates(words=4))
    _, expected = brute(ROWS, 4)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, c in expected.items() if i == c)
    assert "_gone" in left.columns


def test_empty_table(make_docs):
    assert M.near_duplicates(make_docs([])).collect() == []


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(1, 1)],
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50)],
        [(9, 8), (8, 7), (3, 9), (20, 21), (21, 2), (5, 5), (9, 8)],
    ],
)
def test_connected_components(spark, links):
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).df
    expected = roots({n for p in links for n in p}, links)
    assert {r.node: r.component for r in found.collect()} == {n: c for n, c in expected.items() if n != c}


def test_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(C, "_large_star", None)
    links = [(1, i) for i in range(2, 9)] + [(20, 30), (31, 20), (5, 5)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).df
    assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(range(2, 9), 1), 30: 20, 31: 20}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sets, expected = brute(rows, 4)
    found = queries.QUERIES["op2_minhash_odd_sketch"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), c) for i, c in expected.items()}

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import manifest
from corpusmill.llm.manifest import Manifest, addresses, full_size, verify_documents
from corpusmill.plans.materialize import scratch_path


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        first = i // 3 * 3
        run = level[first : first + 3]
        yield i - first, run[: i - first] + run[i - first + 1 :]
        i //= 3


def brute_force(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row, H(*map(spelled, row))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        trees[name] = tree([leaf for _, leaf in by_source[name]])
    top = tree([trees[name][-1][0] for name in names])
    found = []
    for at, name in enumerate(names):
        for i, (row, leaf) in enumerate(by_source[name]):
            way = [*steps(trees[name], i), *steps(top, at)]
            folded = H(*map(spelled, (*row[:4], tampered(row))))
            for place, others in way:
                folded = H(*others[:place], folded, *others[place:])
            proof = H(*[d for _, others in way for d in others])
            root = top[-1][0]
            found.append((row[0], leaf, trees[name][-1][0], root, proof, folded, folded == root))
    return sorted(found, key=str)


def cut(row):
    hit = row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
    return row[4].replace("\n", "") if hit else row[4]


def cut_column():
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_fill_the_layout_once(levels):
    found = sorted(a for depth in range(levels) for a in addresses(depth, levels).tolist())
    assert found == list(range(full_size(levels)))


def test_lower_subtrees_are_stretches():
    # Four levels: two on top (4 nodes), then nine subtrees of four nodes each.
    assert addresses(0, 4).tolist() == [0] and addresses(1, 4).tolist() == [1, 2, 3]
    assert addresses(2, 4).tolist() == list(range(4, 40, 4))
    assert addresses(3, 4).tolist() == [4 + 4 * t + k for t in range(9) for k in (1, 2, 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28, 3**30, 3**30 + 1])
def test_tree_height(spark, n):
    expected = 0
    while 3**expected < n:
        expected += 1
    assert manifest.tree_height(n) == expected
    assert spark.range(1).select(manifest.tree_height(F.lit(n).cast("bigint"))).first()[0] == expected


def many_rows():
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "en" if i % 2 else None, i % 50, f"text {i}\nline\n") for i in range(700)]
    rows += [(10_000 + i, f"only{i}", None, None, "x\n" * i) for i in range(12)]
    rows += [(None, None, None, None, None), (5, None, "", 0, ""), (5, None, "", 0, "\n"), (6, "", "", -1, None)]
    rows += [(7, "hot", "en", 1, "again"), (7, "hot", "en", 1, "again"), (8, "漢é", "en", 1, "long ünï \n" * 50_000)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_brute_force_whatever_the_height_of_blocks(spark, monkeypatch, height):
    rows = many_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "position", "digest", "path", "id", "block")})
    build = Manifest.build
    monkeypatch.setattr(Manifest, "build", lambda leaves, folder: build(leaves, folder, height))
    found = verify_documents(docs, scratch_path(spark, "manifest"), cut_column())
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = brute_force(rows, cut)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert {r[6] for r in expected} == {True, False}


def test_a_stored_manifest_opens_again(spark):
    rows = many_rows()[:300]
    leaves = spark.createDataFrame(rows, SCHEMA).select(
        "source", F.col("doc_id").alias("id"), F.unhex(manifest.leaf_digest(*map(F.col, ["doc_id", "source", "lang", "n_chars", "text"]))).alias("digest")
    )
    folder = scratch_path(spark, "manifest")
    built = Manifest.build(leaves, folder, 2)
    again = Manifest.open(spark, folder, len(built.sources), len(built.top), 2)
    assert again.root() == built.root() == bytes.fromhex(brute_force(rows, cut)[0][3])
    assert again.paths().count() == 300


def test_one_row_and_empty_tables(spark):
    one = [(1, "a", None, None, "text")]
    found = verify_documents(spark.createDataFrame(one, SCHEMA), scratch_path(spark, "manifest"), cut_column()).collect()
    assert [tuple(r) for r in found] == brute_force(one, cut)
    assert found[0].leaf == found[0].root and found[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert verify_documents(spark.createDataFrame([], SCHEMA), scratch_path(spark, "manifest"), cut_column()).collect() == []

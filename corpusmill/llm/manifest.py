"""Merkle manifest of a dataset: digests of rows, of sources and of the whole, with proofs.

A leaf is the digest of a row. Per source, leaves ascend by ID; every run of ``ARITY``
neighbours becomes the digest of their digests, until one is left, the subroot. Subroots
ascend by source and make the root in the same way. A proof lists the siblings on the way
from a leaf to the root.

A tree is cut into aligned blocks of up to ``height`` levels above their leaves. Inside, a
block lies in van Emde Boas order: the upper half of its levels first, then each lower
subtree as one stretch, all of them laid out in the same way. The address of a node follows
from its level and index alone and serves construction as well as the look-up of siblings;
any subtree that fits a cache line or a page touches few of them, whatever their size.
The roots of blocks are leaves of the next table of blocks, so trees of any size take a few
rounds, each with one shuffle of narrow rows and bounded blocks, whatever the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm.common import broadcast_if_small, ship_package
from corpusmill.plans.materialize import materialize
from corpusmill.plans.prefix import dense_positions

ARITY = 3
# Levels above the leaves of a block: 3^7 leaves, 3,280 digests, 105 KB.
HEIGHT = 7
DIGEST_BYTES = 32
# Output of a task is handed on after so many leaves or blocks.
LEAVES_AT_A_TIME = 8_192
BLOCKS_AT_A_TIME = 512
# Paths of so many blocks, about 1.5 KB each, may be broadcast to the blocks below.
BROADCAST_PATHS = 10_000


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests written as lower-case hex."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its UTF-8 length, a colon and itself; NULL is a hyphen."""
    spelled = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(spelled).cast("string"), F.lit(":"), spelled), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex digest of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_height(n: Column | int, arity: int = ARITY):
    """Levels above ``n`` leaves until one node is left, from powers that integers hold exactly."""
    powers = [arity**k for k in range(40) if arity**k < 2**63]
    if isinstance(n, int):
        return sum(p < n for p in powers)
    count = F.lit(0)
    for p in powers:
        count = count + (F.lit(p).cast("bigint") < n).cast("int")
    return count


def full_size(levels: int, arity: int = ARITY) -> int:
    """Nodes of a complete tree of so many levels."""
    return (arity**levels - 1) // (arity - 1)


@lru_cache(maxsize=256)
def addresses(depth: int, levels: int, arity: int = ARITY) -> np.ndarray:
    """Places of the nodes ``depth`` levels below the root, left to right, in a layout of ``levels``.

    The upper half of the levels is one tree; below each of its leaves hang ``arity``
    subtrees, stored one after the other behind it.
    """
    if levels == 1:
        return np.zeros(1, np.int64)
    upper = levels // 2
    if depth < upper:
        return addresses(depth, upper, arity)
    lower = levels - upper
    inner = addresses(depth - upper, lower, arity)
    starts = full_size(upper, arity) + np.arange(arity**upper, dtype=np.int64) * full_size(lower, arity)
    return (starts[:, None] + inner[None, :]).reshape(-1)


@lru_cache(maxsize=64)
def places(height: int, arity: int = ARITY) -> list[list[int]]:
    """Byte offsets of all nodes of a block, by levels from its leaves up."""
    return [(addresses(height - up, height + 1, arity) * DIGEST_BYTES).tolist() for up in range(height + 1)]


class Block:
    """A subtree of ``height`` levels above its leaves; nodes that the ragged edge lacks stay empty."""

    def __init__(self, height: int, n_leaves: int, nodes: bytes | bytearray, arity: int = ARITY):
        self.height, self.n_leaves, self.nodes, self.arity = height, n_leaves, nodes, arity
        self.widths = [n_leaves]
        for _ in range(height):
            self.widths.append(-(-self.widths[-1] // arity))
        self.places = places(height, arity)

    @classmethod
    def build(cls, height: int, leaves: list[bytes], arity: int = ARITY) -> Block:
        block = cls(height, len(leaves), bytearray(full_size(height + 1, arity) * DIGEST_BYTES), arity)
        for i, leaf in enumerate(leaves):
            block._put(0, i, leaf)
        for up in range(1, height + 1):
            for i in range(block.widths[up]):
                block._put(up, i, digest(block.run(up - 1, i)))
        return block

    def _put(self, up: int, i: int, value: bytes) -> None:
        at = self.places[up][i]
        self.nodes[at : at + DIGEST_BYTES] = value

    def node(self, up: int, i: int) -> bytes:
        """Node ``i`` of the level ``up`` levels above the leaves."""
        at = self.places[up][i]
        return bytes(self.nodes[at : at + DIGEST_BYTES])

    def run(self, up: int, parent: int) -> list[bytes]:
        """The children of a node one level higher."""
        first = parent * self.arity
        return [self.node(up, i) for i in range(first, min(first + self.arity, self.widths[up]))]

    @property
    def root(self) -> bytes:
        return self.node(self.height, 0)

    def path(self, i: int) -> list[tuple[int, list[bytes]]]:
        """(own place in the run, the run's other nodes) from leaf ``i`` up to the block's root."""
        steps = []
        for up in range(self.height):
            parent, place = divmod(i, self.arity)
            run = self.run(up, parent)
            steps.append((place, run[:place] + run[place + 1 :]))
            i = parent
        return steps


def fold(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for place, others in steps:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def pack_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Per step a byte of place, a byte of sibling count, and the siblings."""
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in steps)


def unpack_path(packed: bytes) -> list[tuple[int, list[bytes]]]:
    steps, at = [], 0
    while at < len(packed):
        place, n = packed[at], packed[at + 1]
        at += 2
        steps.append((place, [packed[at + k * DIGEST_BYTES : at + (k + 1) * DIGEST_BYTES] for k in range(n)]))
        at += n * DIGEST_BYTES
    return steps


# Columns of a block; those of the leaves' payload follow as arrays.
BLOCK = "tree string, block bigint, tree_height int, height int, n_leaves int, root binary, nodes binary"
NODE = ["tree", "position", "tree_height", "digest"]


def build_blocks(nodes: DataFrame, level: int, height: int = HEIGHT) -> DataFrame:
    """One row per block of neighbours in rows (tree, position, tree_height, digest, payload...).

    Rows of one block meet in one task, at most ``ARITY ** height`` of them; payload columns
    become arrays in the order of the leaves. Digests are binary.
    """
    ship_package(nodes.sparkSession)
    payload = [f for f in nodes.schema.fields if f.name not in NODE]
    schema = T.StructType(
        [*T._parse_datatype_string(BLOCK).fields, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in payload]]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    width = ARITY**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, made, n_made = None, [], [], 0

        def close() -> tuple:
            block = Block.build(min(height, rows[0][2] - level), [r[3] for r in rows])
            extra = [[r[4 + k] for r in rows] for k in range(len(payload))]
            return (*key, rows[0][2], block.height, len(rows), block.root, bytes(block.nodes), *extra)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*done), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if (now := (row[0], row[1] // width)) != key:
                    if rows:
                        made.append(close())
                        n_made += len(rows)
                    key, rows = now, []
                    if n_made >= LEAVES_AT_A_TIME or len(made) >= BLOCKS_AT_A_TIME:
                        yield batch_of(made)
                        made, n_made = [], 0
                rows.append(row)
        if rows:
            yield batch_of([*made, close()])

    together = (
        nodes.select(*NODE, *[f.name for f in payload])
        .withColumn("_block", F.floor(F.col("position") / width).cast("bigint"))
        .repartition("tree", "_block")
        .sortWithinPartitions("tree", "_block", "position")
        .drop("_block")
    )
    return together.mapInArrow(run, schema)


def grow(leaves: DataFrame, n_rounds: int, folder: str, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of blocks, one a round, each stored below ``folder``; roots of one are leaves of the next."""
    spark, nodes, tables = leaves.sparkSession, leaves, []
    for number in range(n_rounds):
        level = number * height
        blocks = build_blocks(nodes, level, height)
        blocks.write.parquet(f"{folder}/round_{number}")
        tables.append(spark.read.schema(blocks.schema).parquet(f"{folder}/round_{number}"))
        nodes = tables[-1].where(F.col("tree_height") > level + height).select(
            "tree", F.col("block").alias("position"), "tree_height", F.col("root").alias("digest")
        )
    return tables


def rounds_for(tree_height: int, height: int = HEIGHT) -> int:
    return max(1, -(-tree_height // height))


def ends_in(number: int, height: int = HEIGHT) -> Column:
    """Whether the tree of a row has its root in this round's blocks."""
    return F.greatest(F.ceil(F.col("tree_height") / height), F.lit(1)) == number + 1


def roots(tables: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, tree_height, digest): the last node of each tree."""
    found = [
        blocks.where(ends_in(number, height)).select("tree", "tree_height", F.col("root").alias("digest"))
        for number, blocks in enumerate(tables)
    ]
    return reduce(DataFrame.unionByName, found)


def _block_paths(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Per leaf of the blocks its tree, position, digest, path to the root, subroot and payload."""
    payload = [f for f in blocks.schema.fields if isinstance(f.dataType, T.ArrayType)]
    schema = T.StructType(
        [
            *T._parse_datatype_string("tree string, position bigint, digest binary, path binary, subroot binary").fields,
            *[T.StructField(f.name, f.dataType.elementType) for f in payload],
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    width = ARITY**height
    held = blocks.join(
        broadcast_if_small(above, BROADCAST_PATHS).select("tree", F.col("position").alias("block"), "path", "subroot"),
        ["tree", "block"],
    ).select("tree", "block", "height", "n_leaves", "nodes", "path", "subroot", *[f.name for f in payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tree, number, own, n, nodes, rest, subroot, *extra = [c[at].as_py() for c in batch.columns]
                block = Block(own, n, nodes)
                columns = [
                    [tree] * n,
                    range(number * width, number * width + n),
                    [block.node(0, i) for i in range(n)],
                    [pack_path(block.path(i)) + rest for i in range(n)],
                    [subroot] * n,
                    *extra,
                ]
                arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return held.mapInArrow(run, schema)


def descend(tables: list[DataFrame], of_trees: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Paths of all leaves: from the last round down, each block hands its path to those below.

    ``of_trees`` has (tree, tree_height, path, subroot): the way from each tree's root on.
    """
    below = None
    for number in reversed(range(len(tables))):
        above = of_trees.where(ends_in(number, height)).select(
            "tree", F.lit(0).cast("bigint").alias("position"), "path", "subroot"
        )
        if below is not None:
            above = above.unionByName(materialize(below.select("tree", "position", "path", "subroot")))
        below = _block_paths(tables[number], above, height)
    return below


@dataclass(frozen=True)
class Manifest:
    """Stored blocks of the trees of all sources, and of the tree over their subroots."""

    folder: str
    sources: list[DataFrame]
    top: list[DataFrame]
    height: int = HEIGHT

    @classmethod
    def build(cls, leaves: DataFrame, folder: str, height: int = HEIGHT) -> Manifest:
        """From rows (source, id, digest, payload...); digests binary, ``folder`` new and shared.

        Ties of one ID are ordered by digest. NULL IDs come first, as do rows of a NULL source.
        """
        spark = leaves.sparkSession
        tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
        placed = dense_positions(
            leaves.withColumns({"tree": tree}).drop("source"), ["tree"], ["id", "digest"], "position"
        )
        sizes = materialize(
            leaves.groupBy(tree.alias("tree")).count().select("tree", tree_height(F.col("count")).alias("tree_height"))
        )
        highest = sizes.agg(F.max("tree_height")).first()[0] or 0
        sized = placed.join(broadcast_if_small(sizes), "tree")
        sources = grow(sized, rounds_for(highest, height), f"{folder}/sources", height)

        subroots = dense_positions(roots(sources, height).select("tree", "digest"), [], ["tree"], "position")
        top_height = tree_height(sizes.count())
        top = grow(
            subroots.select(
                F.lit("").alias("tree"), "position", F.lit(top_height).alias("tree_height"), "digest", F.col("tree").alias("of")
            ),
            rounds_for(top_height, height),
            f"{folder}/top",
            height,
        )
        return cls(folder, sources, top, height)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, n_rounds: int, n_top: int, height: int = HEIGHT) -> Manifest:
        def read(kind: str, n: int) -> list[DataFrame]:
            return [spark.read.parquet(f"{folder}/{kind}/round_{k}") for k in range(n)]

        return cls(folder, read("sources", n_rounds), read("top", n_top), height)

    def root(self) -> bytes | None:
        """Digest of the whole dataset, NULL for an empty one."""
        found = roots(self.top, self.height).first()
        return bytes(found.digest) if found else None

    def paths(self) -> DataFrame:
        """(tree, position, digest, path, subroot, payload...): the proof of every leaf."""
        start = roots(self.top, self.height).select(
            "tree", "tree_height", F.lit(b"").alias("path"), F.col("digest").alias("subroot")
        )
        upper = descend(self.top, start, self.height)
        of_trees = roots(self.sources, self.height).join(
            upper.select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot")), "tree"
        )
        return descend(self.sources, materialize(of_trees), self.height)


def fold_paths(paths: DataFrame, given: str, proof_col: str, root_col: str) -> DataFrame:
    """All columns, the digest of each proof's siblings, and the root that ``given`` folds to; both hex."""
    ship_package(paths.sparkSession)
    schema = T.StructType([*paths.schema.fields, T.StructField(proof_col, T.StringType()), T.StructField(root_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for leaf, path in zip(batch.column(given).to_pylist(), batch.column("path").to_pylist()):
                steps = unpack_path(path)
                proofs.append(digest([d for _, others in steps for d in others]).hex())
                folded.append(fold(leaf, steps).hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=schema.names)

    return paths.mapInArrow(run, schema)


def verify_documents(docs: DataFrame, folder: str, tampered_text: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Proof of every row, and whether the row with ``tampered_text`` still verifies against the root.

    ``columns`` are the ID, the source, further values, and last the text; a leaf is the
    digest of all of them. NULL and empty values differ. Equal rows are leaves of their own,
    side by side; rows of one ID follow their digests. An empty table has no root and no
    rows. Other columns are not read.
    """
    id_col, source, *_, text = columns
    values = [F.col(f"`{c}`") for c in columns]
    leaves = docs.select(
        values[1].cast("string").alias("source"),
        values[0].alias("id"),
        F.unhex(leaf_digest(*values)).alias("digest"),
        F.unhex(F.when(~tampered_text.eqNullSafe(values[-1]), leaf_digest(*values[:-1], tampered_text))).alias("tampered"),
    )
    manifest = Manifest.build(materialize(leaves), folder)
    root = manifest.root()
    paths = manifest.paths().withColumn("_given", F.coalesce("tampered", "digest"))
    folded = fold_paths(paths, "_given", "proof_sha256", "folded_root")
    whole = F.lit(root.hex() if root else None).cast("string")
    return folded.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        whole.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == whole).alias("verified"),
    )

"""Token counts that follow edits.

A document keeps a segment tree over runs of pre-tokens: each leaf knows its code points and
its tokens, each node the sums below. An edit re-encodes the leaves that it touches, with two
code points of context before it, up to the next old leaf boundary that is a boundary of the
new text as well; from there on the pre-tokens are the same. Then only the sums above change.

The pre-token pattern looks ahead at most two code points past the end of a match and never
back, which is what makes both ends of the region safe.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ship_package, whole_text

LEAF = 64
CONTEXT = 2
CACHED_PIECES = 800_000
LONGEST_CACHED = 64
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class PieceCounter:
    """Splits text into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def look_up(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= LONGEST_CACHED:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
            self.known[piece] = n
        return n

    def leaves(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of runs of LEAF pieces."""
        known, look_up = self.known, self.look_up
        tokens = np.array([known.get(p) or look_up(p) for p in pieces], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.arange(0, len(pieces), LEAF)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.add.reduceat(sizes, starts), np.add.reduceat(tokens, starts)


class SumTree:
    """Complete binary tree over leaves: node i has the children 2i and 2i + 1, node 1 is the root."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.rebuild(chars, tokens)

    def rebuild(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.leaves, 0] = chars
        self.sums[self.width : self.width + self.leaves, 1] = tokens
        low = self.width
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where it starts; the last one beyond the end."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if place < before + left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                before += left
                node = 2 * node + 1
        return node - self.width, before

    def replace(self, first: int, last: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put new leaves in the place of leaves first to last - 1; unused ones become empty."""
        room = last - first
        if len(chars) > room:
            kept = self.sums[self.width : self.width + self.leaves]
            self.rebuild(
                np.concatenate([kept[:first, 0], chars, kept[last:, 0]]),
                np.concatenate([kept[:first, 1], tokens, kept[last:, 1]]),
            )
            return
        low, high = self.width + first, self.width + last
        self.sums[low:high] = 0
        self.sums[low : low + len(chars), 0] = chars
        self.sums[low : low + len(chars), 1] = tokens
        while low > 1:
            low, high = low // 2, (high - 1) // 2 + 1
            self.sums[low:high] = self.sums[2 * low : 2 * high].reshape(-1, 2, 2).sum(axis=1)


class CountedText:
    """A text with its tree."""

    def __init__(self, text: str, counter: PieceCounter, tree: SumTree | None = None):
        self.text, self.counter = text, counter
        self.tree = tree or SumTree(*counter.leaves(counter.pattern.findall(text)))
        self.reencoded = 0

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put ``replacement`` in the place of code points start to end - 1, both cut to the text."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        shift = len(replacement) - (end - start)
        self.text = self.text[:start] + replacement + self.text[end:]
        tree = self.tree
        first, begin = tree.find(max(0, start - CONTEXT)) if tree.leaves else (0, 0)
        settled = start + len(replacement)
        last, old = first, begin  # old boundary before leaf `last`
        pieces = []
        here = begin
        for m in self.counter.pattern.finditer(self.text, begin):
            pieces.append(m[0])
            here = m.end()
            if here >= settled:
                while last < tree.leaves and old + shift < here:
                    old += int(tree.sums[tree.width + last, 0])
                    last += 1
                if old >= end and old + shift == here:
                    break
        else:
            last = tree.leaves
        self.reencoded += here - begin
        tree.replace(first, last, *self.counter.leaves(pieces))


@lru_cache(maxsize=4)
def piece_counter(ranks: bytes, pattern: str) -> PieceCounter:
    """One counter per worker and vocabulary."""
    return PieceCounter(ranks, pattern)


@dataclass(frozen=True)
class Vocabulary:
    """Path of a rank file and the pre-token pattern."""

    path: str
    pattern: str

    def shared(self, df: DataFrame) -> Broadcast[bytes]:
        ship_package(df.sparkSession)
        with open(self.path, "rb") as f:
            return df.sparkSession.sparkContext.broadcast(f.read())


TREE = "leaf_chars array<int>, leaf_tokens array<int>"


def _tree_columns(trees: list[SumTree]) -> list[pa.Array]:
    rows = [t.sums[t.width : t.width + t.leaves] for t in trees]
    return [pa.array([r[:, i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (0, 1)]


def build_trees(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the leaves of each row's tree, from the whole text.

    NULL counts as empty: no leaves, no tokens. Every row gives a row.
    """
    shared, pattern = vocabulary.shared(docs), vocabulary.pattern
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(shared.value, pattern)
        for batch in batches:
            trees = [CountedText(t.as_py(), counter).tree for t in batch.column("text")]
            counts = pa.array([t.n_tokens for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), counts, *_tree_columns(trees)], names=["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"]
            )

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {TREE}")


def apply_edits(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Apply the ``edits`` of each row in order and bring its tree up to date.

    ``rows`` has ``doc_id``, ``text``, ``edits`` and either the leaves of the text's tree or NULL for
    a text not counted yet. Returns ``doc_id``, the new ``text``, ``tokens_before``, ``n_tokens``,
    ``n_reencoded`` (code points encoded again) and the new leaves. Places count code points of
    the text as earlier edits left it and are cut to it; NULL edits or replacements are empty.
    """
    shared, pattern = vocabulary.shared(rows), vocabulary.pattern
    source = rows.select("doc_id", whole_text().alias("text"), F.col("edits").cast(EDITS).alias("edits"), "leaf_chars", "leaf_tokens")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "tokens_before", "n_tokens", "n_reencoded", "leaf_chars", "leaf_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(shared.value, pattern)
        for batch in batches:
            done, before = [], []
            for text, edits, chars, tokens in zip(*[batch.column(c) for c in ("text", "edits", "leaf_chars", "leaf_tokens")]):
                tree = SumTree(np.array(chars.as_py(), np.int64), np.array(tokens.as_py(), np.int64)) if chars.is_valid else None
                counted = CountedText(text.as_py(), counter, tree)
                before.append(counted.tree.n_tokens)
                for e in edits.as_py() or ():
                    counted.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                done.append(counted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([d.text for d in done], pa.string()),
                    pa.array(before, pa.int64()),
                    pa.array([d.tree.n_tokens for d in done], pa.int64()),
                    pa.array([d.reencoded for d in done], pa.int64()),
                    *_tree_columns([d.tree for d in done]),
                ],
                names=names,
            )

    schema = f"doc_id {kind}, text string, tokens_before bigint, n_tokens bigint, n_reencoded bigint, {TREE}"
    return source.mapInArrow(run, schema)


def edits_by_document(edits: DataFrame) -> DataFrame:
    """``doc_id`` and its ``edits`` in the order of ``seq``, from one row per edit.

    All edits of a document go to the row that holds its text; a document is edited in one task.
    """
    one = F.struct("seq", "start", "end", "replacement")
    ordered = F.array_sort(F.collect_list(one))
    return edits.groupBy("doc_id").agg(
        F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))).alias("edits")
    )


def sample_edits(text: Column) -> Column:
    """Three edits that follow from the text: a cut at a third, an insertion at two thirds, a new end."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")

    def one(start: Column, end: Column, replacement: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), replacement.alias("replacement"))

    return F.array(
        one(third, third + 20, F.lit("")),
        one(2 * third, 2 * third, F.substring(text, 1, 10)),
        one(n - 11, n + 20, F.lit(" we're done.")),
    )


def recount(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document before and after ``sample_edits``, in one pass."""
    text = whole_text(text_col)
    none = F.lit(None).cast("array<int>")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), sample_edits(text).alias("edits"), none.alias("leaf_chars"), none.alias("leaf_tokens")
    )
    done = apply_edits(rows, vocabulary)
    return done.select(
        "doc_id",
        F.col("tokens_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        F.length("text").cast("bigint").alias("n_chars_edited"),
        F.col("n_reencoded").alias("n_chars_reencoded"),
    )

"""Token IDs in compressed binary files: canonical Huffman codes of limited length.

Counts of all IDs give code lengths by package-merge, so that no code is longer than a
limit and one table look-up decodes an ID. Codes are canonical: the lengths alone restore
them. Files hold blocks of whole documents in ascending order of their IDs. A block decodes
by itself: it carries its documents, their lengths, a bit stream, and the bit offset of
every ``STEP``-th ID. Decoding starts at all of these checkpoints at once and steps through
their stretches side by side; a slice of IDs starts at the checkpoint before it.

A folder of token files has three tables: ``codebook`` (symbol, length), ``parts`` (IDs
before each file) and ``blocks``. They are Parquet, whose commit survives lost executors on
any store that Spark reaches; the payload in them is this module's own.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm.common import broadcast_if_small, ship_package, stage, whole_text

# Longest code in bits: the decoding table has 2^18 entries.
LIMIT = 18
# IDs between two checkpoints.
STEP = 256
# A block is closed once it holds so many IDs; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
TEXTS_AT_A_TIME = 64
# Texts are encoded together up to so many characters; a longer one is taken alone.
CHARS_AT_A_TIME = 4 << 20
# A worker keeps at most twice so many stretches of text with their IDs, about 200 bytes each.
CACHED_STRETCHES = 1_000_000
LONGEST_CACHED = 64
# Marks where texts are split; one that holds it is split in another way.
CUT = "\x01"
# Unicode white space as the tokenizer's pattern knows it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Stretches at whose ends the tokenizer always cuts: letters and the space before them up to white
# space or a mark, else all up to white space, white space but its last character, and that one
# where it is no space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
STRETCHES = re.compile(f" ?[{LETTERS}]+(?=[{WHITE},.;:!?]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
ONE_PIECE = re.compile(f" ?[{LETTERS}]+")
# A letter with a mark behind it, where a word ends.
WORD_END = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([,.;:!?])"
# White space other than line breaks and spaces.
ODD_WHITE = re.compile("[\\t\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for a count of 0: least total, none over ``limit``.

    Package-merge: the leaves are merged ``limit`` times with the pairs of the list before;
    of the last list, as many items as 2n - 2 are taken, and each taken leaf costs a bit.
    Both kinds stay in order, so a list is told by which of its items are pairs.
    """
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(present)
    if n > 2**limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    if n <= 1:
        lengths[present] = 1
        return lengths
    by_count = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[by_count].astype(np.int64)
    items, is_pair = np.empty(0, np.int64), []
    for _ in range(limit):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items = both[order]
        is_pair.append(order >= n)
    taken = 2 * n - 2
    bits = np.zeros(n, np.uint8)
    for pairs_here in reversed(is_pair):
        n_pairs = int(pairs_here[:taken].sum())
        bits[: taken - n_pairs] += 1
        taken = 2 * n_pairs
    lengths[by_count] = bits
    return lengths


class Codebook:
    """Codes, and the table that decodes them, of given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        ordered = used[np.lexsort((used, lengths[used]))]
        self.longest = int(lengths.max(initial=1))
        # In steps of the longest code, the codes lie end to end from 0 on.
        spans = np.int64(1) << (self.longest - self.lengths[ordered])
        starts = np.cumsum(spans) - spans
        if len(ordered) and starts[-1] + spans[-1] > 1 << self.longest:
            raise ValueError("no prefix code has these lengths")
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ordered] = (starts >> (self.longest - self.lengths[ordered])).astype(np.uint64)
        # Symbol and length in one number; 0 where no code begins so.
        self.table = np.zeros(1 << self.longest, np.int64)
        filled = np.repeat((ordered << 5) | self.lengths[ordered], spans)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bit stream, checkpoints): the latter are little-endian 64-bit offsets."""
        if not len(ids):
            return b"", b""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, shift = starts >> 6, 64 - (starts & 63) - bits
        codes = self.codes[ids]
        fits = np.where(shift >= 0, codes << np.maximum(shift, 0).astype(np.uint64), codes >> np.maximum(-shift, 0).astype(np.uint64))
        # Every word but perhaps the last has a code that begins in it.
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1] + 63) >> 6, np.uint64)
        words[word[first]] = np.bitwise_or.reduceat(fits, first)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= codes[over] << (64 + shift[over]).astype(np.uint64)
        stream = words.astype(">u8").tobytes()[: int(ends[-1] + 7) >> 3]
        return stream, starts[::STEP].astype("<u8").tobytes()

    def decode(self, stream: bytes, checkpoints: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """IDs ``first`` to ``last`` (exclusive) of the ``n`` in a block."""
        last = n if last is None else min(last, n)
        if first >= last:
            return np.empty(0, np.uint32)
        lanes = slice(first // STEP, (last - 1) // STEP + 1)
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)[lanes]
        begin = int(at[0]) >> 3
        margin = STEP * self.longest // 8 + 8
        raw = np.frombuffer(stream[begin : (int(at[-1]) >> 3) + margin] + bytes(margin), np.uint8).astype(np.int64)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at -= begin * 8
        steps = min(STEP, n - lanes.start * STEP)
        out = np.empty((steps, len(at)), np.uint32)
        mask = (1 << self.longest) - 1
        for step in range(steps):
            hit = self.table[(window[at >> 3] >> (32 - self.longest - (at & 7))) & mask]
            out[step] = hit >> 5
            at += hit & 31
        skip = lanes.start * STEP
        return out.T.reshape(-1)[first - skip : last - skip]


@lru_cache(maxsize=4)
def _codebook(lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(lengths, np.uint8))


class Encoder:
    """The library's encoder, asked once for each stretch of text that recurs.

    The file's tokenizer cuts a text by a pattern before it merges, and never merges across a
    cut. Texts are split where the pattern cuts in any case, many texts at once; the IDs of
    a text are those of its stretches, and only distinct ones are looked up. Texts with
    uncommon white space are split one by one, and a text that spells out a special token goes
    to the library as it is. IDs are little-endian, ``width`` bytes each.
    """

    def __init__(self, file_text: str, width: int):
        # Spark has a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.kind, self.code = f"<u{width}", {2: "H", 4: "I"}[width]
        spec = json.loads(file_text)
        before = spec["pre_tokenizer"]
        self.cuts = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        # The visible letter that the vocabulary spells each other byte with.
        self.letters = {b: next(spare) for b in range(256) if b not in shown}
        self.space = chr(self.letters[0x20])
        # IDs of stretches of late, and of the time before. What is met again moves on, the rest is dropped.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _ask_library(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _ask(self, stretch: str) -> bytes:
        word = stretch[1:] if stretch[0] == " " else stretch
        if word.isascii() and word.isalpha():
            # A single piece, whose letters the vocabulary spells as they are.
            spelled = stretch if word is stretch else self.space + word
        elif ONE_PIECE.fullmatch(stretch):
            spelled = stretch.encode().decode("latin-1").translate(self.letters)
        else:
            return self._ask_library(stretch)
        return self._packed([t.id for t in self.model.tokenize(spelled)])

    def ids_of(self, stretches: list[str]) -> list[bytes]:
        """IDs of each stretch."""
        if len(self.young) >= CACHED_STRETCHES:
            self.old, self.young = self.young, {}
        young, old, ask = self.young, self.old, self._ask
        found = []
        for stretch in stretches:
            ids = young.get(stretch)
            if ids is None:
                ids = (old.get(stretch) or ask(stretch)) if stretch else b""
                if len(stretch) <= LONGEST_CACHED:
                    young[stretch] = ids
            found.append(ids)
        return found

    def _alone(self, text: str) -> bytes:
        if not self.cuts or any(t in text for t in self.special):
            return self._ask_library(text)
        return b"".join(self.ids_of(STRETCHES.findall(text)))

    def _even(self, text: str) -> bool:
        """Whether single spaces and up to two line breaks are all the white space between words."""
        return not (
            "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or CUT in text
            or text.endswith((" ", "\n\n")) or text.startswith(" ") or ODD_WHITE.search(text) or any(t in text for t in self.special)
        )

    def _together(self, texts: list[str]) -> list[bytes]:
        """IDs of even texts: distinct stretches are looked up, all others follow by position."""
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), " ", CUT + " ")
        marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
        marked = pc.replace_substring_regex(marked, WORD_END, rf"\1{CUT}\2")
        split = pc.split_pattern(marked, CUT)
        coded = split.flatten().dictionary_encode()
        found = self.ids_of(coded.dictionary.to_pylist())
        pieces = np.empty(len(found), object)
        pieces[:] = found
        inline = pieces[coded.indices.to_numpy(zero_copy_only=False)].tolist()
        bounds = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
        return [b"".join(inline[a:z]) for a, z in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        even = [self.cuts and bool(text) and self._even(text) for text in texts]
        together = [text for text, is_even in zip(texts, even) if is_even]
        done = iter(self._together(together) if together else ())
        return [next(done) if is_even else self._alone(text) if text else b"" for text, is_even in zip(texts, even)]


@lru_cache(maxsize=4)
def _encoder(file_text: str, width: int) -> Encoder:
    return Encoder(file_text, width)


def id_width(file_text: str, end_id: int) -> int:
    """Bytes that hold any ID of a tokenizer file."""
    spec = json.loads(file_text)
    largest = max([end_id, *spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    return 2 if largest < 1 << 16 else 4


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded length of texts, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHARS_AT_A_TIME, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def token_rows(docs: DataFrame, file_text: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, crc, ids): IDs of each whole text and ``end_id``, ``width`` bytes each, and the CRC-32 of them as 32-bit integers."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(file_text)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("n bigint, crc bigint, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, width)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for part in _slices(batch):
                ids = [i + end for i in encoder.encode(part.column("text").to_pylist())]
                columns = [
                    part.column("id"),
                    pa.array([len(i) // width for i in ids], pa.int64()),
                    pa.array([crc32(np.frombuffer(i, encoder.kind).astype("<u4")) for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def id_counts(rows: DataFrame, width: int) -> DataFrame:
    """(symbol, n) over all IDs of all rows; a task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_A_TIME):
                ids = b"".join(batch.column(0).slice(start, TEXTS_AT_A_TIME).to_pylist())
                here = np.bincount(np.frombuffer(ids, f"<u{width}"), minlength=len(total))
                here[: len(total)] += total
                total = here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    return rows.select("ids").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def fit_lengths(counts: DataFrame, limit: int = LIMIT) -> np.ndarray:
    """Code length of every symbol up to the largest; one count per symbol of the vocabulary is fetched."""
    found = {r.symbol: r.n for r in counts.collect()}
    table = np.zeros(max(found, default=-1) + 1, np.int64)
    for symbol, n in found.items():
        table[symbol] = n
    return code_lengths(table, limit)


def encode_blocks(rows: DataFrame, lengths: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of (id, ids) rows in the order in which tasks have them.

    ``part`` numbers tasks, ``first`` counts the IDs of a part before a block.
    """
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(lengths.astype(np.uint8).tobytes())
    fields = "part int, block int, first bigint, n_ids bigint, lengths array<bigint>, stream binary, checkpoints binary, stream_crc bigint"
    schema = T.StructType([*T._parse_datatype_string(fields).fields, T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = _codebook(shared.value), TaskContext.get().partitionId()
        first = block = held = 0
        ids: list = []
        pieces: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            stream, checkpoints = book.encode(np.concatenate(pieces))
            row = [part, block, first, held, [len(p) for p in pieces], stream, checkpoints, crc32(stream), ids]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=schema.names)

        for batch in batches:
            for doc_id, raw in zip(batch.column("id"), batch.column("ids")):
                ids.append(doc_id.as_py())
                pieces.append(np.frombuffer(raw.as_py(), f"<u{width}"))
                held += len(pieces[-1])
                if held >= block_ids:
                    yield close()
                    first, block, held, ids, pieces = first + held, block + 1, 0, [], []
        if pieces:
            yield close()

    return rows.select("id", "ids").mapInArrow(run, schema)


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files."""

    spark: SparkSession
    folder: str

    @classmethod
    def write(
        cls, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
        text_col: str = "text", limit: int = LIMIT, block_ids: int = BLOCK_IDS,
    ) -> TokenFiles:
        """Tokenize all documents and write them in ascending order of their IDs.

        A NULL text counts as empty; an empty text is its end ID. NULL IDs come first; rows
        of one ID are ordered by number and CRC-32 of their token IDs, equal rows in any
        order. Of an empty table the codebook and the files are empty.
        """
        spark = docs.sparkSession
        with open(tokenizer, encoding="utf-8") as file:
            file_text = file.read()
        width = id_width(file_text, end_id)
        rows = stage(token_rows(docs, file_text, end_id, width, id_col, text_col), "tokens", "zstd")
        lengths = fit_lengths(id_counts(rows.df, width), limit)
        used = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
        spark.createDataFrame(used, "symbol int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
        # Rows of one ID, say NULL, may be many: the further keys let the ranges cut between them.
        apart = rows.df.withColumn("_row", F.monotonically_increasing_id())
        order = ["id", "n", "crc", "_row"]
        ranged = apart.repartitionByRange(*order).sortWithinPartitions(*order)
        encode_blocks(ranged, lengths, width, block_ids).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
        rows.release()
        held = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = held.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("bigint").alias("before"))
        parts.write.parquet(f"{folder}/parts")
        return cls(spark, folder)

    def codebook(self) -> Broadcast[bytes]:
        """Code lengths by symbol, for the workers; as many as the vocabulary has entries."""
        ship_package(self.spark)
        rows = self.spark.read.parquet(f"{self.folder}/codebook").collect()
        lengths = np.zeros(max((r.symbol for r in rows), default=-1) + 1, np.uint8)
        for r in rows:
            lengths[r.symbol] = r.length
        return self.spark.sparkContext.broadcast(lengths.tobytes())

    def blocks(self) -> DataFrame:
        """All blocks, with the number of IDs before each in the whole order as ``start``."""
        parts = self.spark.read.parquet(f"{self.folder}/parts")
        blocks = self.spark.read.parquet(f"{self.folder}/blocks").join(broadcast_if_small(parts), "part")
        return blocks.withColumn("start", F.col("before") + F.col("first"))

    def _decoded(self, fields: str, make) -> DataFrame:
        """Rows (doc_id, start, ``fields``) from ``make(start, ids)`` of each document."""
        blocks, shared = self.blocks(), self.codebook()
        kind = blocks.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(f"start bigint, {fields}").fields])
        kinds = [to_arrow_type(f.dataType) for f in schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = _codebook(shared.value)
            for batch in batches:
                for at in range(batch.num_rows):
                    start, n, lengths, stream, checkpoints, crc, doc_ids = [c[at].as_py() for c in batch.columns]
                    if crc32(stream) != crc:
                        raise ValueError(f"the block of IDs from {start} on is damaged")
                    ids = book.decode(stream, checkpoints, n).astype("<u4")
                    ends = np.cumsum(lengths)
                    rows = [
                        (doc_id, start + int(end) - length, *make(ids[end - length : end]))
                        for doc_id, end, length in zip(doc_ids, ends, lengths)
                    ]
                    arrays = [pa.array(values, k) for values, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        columns = ["start", "n_ids", "lengths", "stream", "checkpoints", "stream_crc", "ids"]
        return blocks.select(*columns).mapInArrow(run, schema)

    def documents(self) -> DataFrame:
        """(doc_id, start, ids): the token IDs of every document, and how many stand before them."""
        return self._decoded("ids array<bigint>", lambda ids: (ids,))

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document as read back."""
        return self._decoded("n_tokens bigint, ids_crc32 bigint", lambda ids: (len(ids), crc32(ids.tobytes())))

    def ids_between(self, first: int, last: int) -> np.ndarray:
        """IDs ``first`` to ``last`` (exclusive) of the whole order, say a training window.

        Reads the blocks that hold them and decodes from the checkpoint before; the caller
        bounds the length.
        """
        hit = self.blocks().where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
        book = _codebook(self.codebook().value)
        found = [
            book.decode(b.stream, b.checkpoints, b.n_ids, max(0, first - b.start), last - b.start)
            for b in sorted(hit.select("start", "n_ids", "stream", "checkpoints").collect())
        ]
        return np.concatenate(found) if found else np.empty(0, np.uint32)

"""BPE encoding and decoding with word ends, by a queue of merge ranks.

A piece is a doubly linked list of symbols. A heap holds the rank and place of every
adjacent pair that can merge; the lowest rank, then the leftmost place, is taken first, and
entries whose symbols have changed meanwhile are skipped. The cost of a piece of n symbols
is n log n, also for very long runs of letters. Decoding joins vocabulary strings.

The vocabulary comes from a tokenizer file (JSON) whose path is a parameter. The driver
reads it once and broadcasts its text; its size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import ship_package, whole_text

# Unicode white space as the tokenizer's pattern knows it.
UNICODE_WHITE = r"\t-\r\x20\x85\xa0  -     　"
# Letters and digits since Unicode 17, which the pattern module knows and the tokenizer doesn't.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
NEWER_CLASS = regex.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER) + "]")
NEWER_START = chr(NEWER[0][0])
# Below, letters are the same in all versions.
LATIN_END = "\u0250"
# The tokenizer's pattern for words.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{UNICODE_WHITE}\p{{L}}\p{{N}}]+")
CHUNKS = regex.compile(rf"[^{UNICODE_WHITE}]+")
# Small letters of capitals that the tokenizer knows but Python's tables don't.
NEWER_CAPITALS = {
    0x1C89: 0x1C8A,
    0xA7CB: 0x0264,
    0xA7CC: 0xA7CD,
    0xA7CE: 0xA7CF,
    0xA7D2: 0xA7D3,
    0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB,
    0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
CAPITALS_START = chr(min(NEWER_CAPITALS))
CAPITAL = re.compile(f"[{''.join(map(chr, NEWER_CAPITALS))}]")
# Also split at by str.split(), though not white space for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Marks that Python's tables reorder or compose and the tokenizer's leave in place.
NEWER_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
NEWER_MARK = regex.compile("([" + "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER_MARKS) + "])")
NEWER_MARK_START = chr(NEWER_MARKS[0][0])
# The Unicode version whose differences the tables above state.
UNICODE = "15.1.0"
# A worker keeps at most twice so many, about 400 bytes each.
CACHED_CHUNKS = 250_000
LONGEST_CACHED = 64
# Low bits of a queue entry hold the place, the others the rank.
PLACE_BITS = 40
# What a chunk becomes: its IDs as native 32-bit integers, and their vocabulary strings joined by spaces.
Coded = tuple[bytes, str]
ROWS_AT_A_TIME = 200


def byte_letters() -> list[str]:
    """Visible stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def split_pieces(chunk: str) -> list[str]:
    """Words and marks of a stretch without white space."""
    highest = max(chunk)
    if highest < LATIN_END and chunk.isalpha():
        return [chunk]
    if highest >= NEWER_START and NEWER_CLASS.search(chunk):
        plain = NEWER_CLASS.sub("\uffff", chunk)
        return [chunk[m.start() : m.end()] for m in PIECES.finditer(plain)]
    return PIECES.findall(chunk)


def compose(text: str) -> str:
    """Canonical composition as the tokenizer's tables have it: newer marks stay where they are."""
    if text.isascii():
        return text
    if max(text) >= NEWER_MARK_START and NEWER_MARK.search(text):
        return "".join([unicodedata.normalize("NFC", part) for part in NEWER_MARK.split(text)])
    return unicodedata.normalize("NFC", text)


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file_text: str):
        if unicodedata.unidata_version != UNICODE:
            raise RuntimeError(f"the tables state what differs from Unicode {UNICODE}, not {unicodedata.unidata_version}")
        spec = json.loads(file_text)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        # Per left ID the rank of each right one that it merges with, and what each rank makes.
        self.ranks: list[dict[int, int]] = [{} for _ in self.names]
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.vocab[left]][self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.suffix) for c in letters]
        self.all_bytes = None not in self.inner and None not in self.final
        found = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({found})") if found else None
        # Chunks of late and of the time before; what is met again moves on, the rest is dropped.
        self.young: dict[str, Coded] = {}
        self.old: dict[str, Coded] = {}

    def merge(self, piece: str) -> list[int]:
        """IDs of one piece; a byte without a vocabulary entry is left out."""
        raw = piece.encode()
        ids = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        if not self.all_bytes:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        made, ranks = self.made, self.ranks
        # Rank of the pair that begins at each place; an entry with another rank is stale.
        pair = [ranks[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        queue = [rank << PLACE_BITS | at for at, rank in enumerate(pair) if rank >= 0]
        if not queue:
            return ids
        pair.append(-1)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        low = (1 << PLACE_BITS) - 1
        while queue:
            entry = pop(queue)
            at = entry & low
            rank = entry >> PLACE_BITS
            if pair[at] != rank:
                continue
            gone, here, left = after[at], made[rank], before[at]
            right = after[at] = after[gone]
            ids[at], ids[gone], pair[gone] = here, -1, -1
            if right < n:
                before[right] = at
                pair[at] = hit = ranks[here].get(ids[right], -1)
                if hit >= 0:
                    push(queue, hit << PLACE_BITS | at)
            else:
                pair[at] = -1
            if left >= 0:
                pair[left] = hit = ranks[ids[left]].get(here, -1)
                if hit >= 0:
                    push(queue, hit << PLACE_BITS | left)
        return [i for i in ids if i >= 0]

    def coded(self, ids: list[int]) -> Coded:
        return array("i", ids).tobytes(), self.decode(ids)

    def chunk(self, chunk: str) -> Coded:
        """What a lower-case stretch without white space becomes."""
        found = self.young.get(chunk)
        if found is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            pieces = split_pieces(chunk)
            if len(pieces) == 1 and len(pieces[0]) == len(chunk):
                found = self.coded(self.merge(chunk))
            else:
                parts = [self.chunk(p) if len(p) < len(chunk) else self.coded(self.merge(p)) for p in pieces]
                found = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])
        if len(chunk) <= LONGEST_CACHED:
            if len(self.young) >= CACHED_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def plain(self, text: str) -> list[Coded]:
        # One capital sigma at a time has the same small letter wherever it stands.
        small = compose(text).replace("Σ", "σ").lower()
        if max(small, default="") >= CAPITALS_START and CAPITAL.search(small):
            small = small.translate(NEWER_CAPITALS)
        chunks = CHUNKS.findall(small) if any(c in small for c in SEPARATORS) else small.split()
        known, chunk = self.young.get, self.chunk
        return [known(c) or chunk(c) for c in chunks]

    def both(self, text: str) -> Coded:
        """IDs of a text, and the text that they decode to."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            parts = self.plain(text)
        else:
            parts = []
            for part in self.special_pattern.split(text):
                if part in self.special:
                    parts.append(self.coded([self.special[part]]))
                elif part:
                    parts.extend(self.plain(part))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])

    def encode(self, text: str) -> array:
        return array("i", self.both(text)[0])

    def decode(self, ids) -> str:
        """Vocabulary strings with a space between them; the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids if names[i]])


@lru_cache(maxsize=4)
def codec(file_text: str) -> WordBpe:
    """One codec per worker and tokenizer; workers are reused between tasks."""
    return WordBpe(file_text)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(docs: DataFrame, tokenizer: str) -> Broadcast[str]:
    """The tokenizer file for the workers; its size is that of the vocabulary."""
    ship_package(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))


def _appended(df: DataFrame, of: str, columns: dict[str, T.DataType], make) -> DataFrame:
    """``df`` and columns that ``make()(value)`` derives from one column, some rows at a time."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, kind) for c, kind in columns.items()]])
    arrow = [{"array": pa.list_(pa.int32()), "string": pa.string()}[kind.typeName()] for kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                made = list(zip(*map(derive, part.column(of)))) or [()] * len(columns)
                arrays = [pa.array(values, type=kind) for values, kind in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and the token IDs of the whole text; NULL counts as empty.

    Empty texts have no IDs. Special tokens spelled out in a text get their own IDs.
    """
    shared = _shared(docs, tokenizer)

    def make():
        bpe = codec(shared.value)
        return lambda text: (bpe.encode(text.as_py() or ""),)

    return _appended(docs, text_col, {ids_col: T.ArrayType(T.IntegerType())}, make)


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text; NULL IDs count as none."""
    shared = _shared(docs, tokenizer)

    def make():
        bpe = codec(shared.value)
        return lambda ids: (bpe.decode(ids.values.to_pylist() if ids.is_valid else ()),)

    return _appended(docs, ids_col, {text_col: T.StringType()}, make)


def encode_decode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """What ``encode`` and then ``decode`` add, in one pass with one codec per worker."""
    shared = _shared(docs, tokenizer)

    def make():
        bpe = codec(shared.value)

        def both(text: pa.Scalar) -> tuple:
            ids, decoded = bpe.both(text.as_py() or "")
            return array("i", ids), decoded

        return both

    return _appended(docs, text_col, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()}, make)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of IDs and digests of the IDs and of the decoded text.

    Encodes and decodes as the two operators do, in one pass that hands back digests only.
    Every input row gives a row: repeated rows repeat, a NULL ID stays NULL.
    """
    shared = _shared(docs, tokenizer)
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids, decoded = bpe.both(text.as_py())
                counts.append(len(ids) // 4)
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                of_ids.append(hashlib.sha256(little_endian(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def little_endian(ids: bytes) -> bytes:
    """Native 32-bit integers as little-endian ones."""
    if sys.byteorder == "big":
        turned = array("i", ids)
        turned.byteswap()
        return turned.tobytes()
    return ids

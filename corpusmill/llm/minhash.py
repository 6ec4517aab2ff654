"""Near-duplicates by banded MinHash, odd sketches and an exact check.

1. One pass over the texts gives each document a signature: a digest of its set of word
   shingles, band keys of MinHash samples, and an odd sketch, a parity bitmap into which
   further MinHash samples are folded. These samples are the least hashes of the bins of one
   permutation, so there are many of them for little work. The population count of the XOR
   of two sketches tells how many samples differ, most precisely for high similarities.
2. Documents with equal sets form a class; one of them speaks for all.
3. Each band bucket has a head, the class that shares most buckets with others. Each class is
   paired with the head of most of its buckets; close pairs are checked on full sets.
4. Buckets whose classes then lie in several components give the pairs across components
   whose sketches are close; those are checked too. Pairs inside a component need no check,
   so a group of n near copies of one text costs about n comparisons and loses nothing.
   Large buckets are cut into tiles, which are compared one by one in whole arrays.
5. Links become components.

With ``bands`` x ``rows`` samples a pair of similarity s shares a bucket with probability
1 - (1 - s^rows)^bands; for the defaults a pair at 0.8 is missed once in 20 million. The
limit for sketches lies six standard deviations beyond what a pair at the threshold shows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stage, broadcast_if_small, ship_package, stage, whole_text
from corpusmill.llm.components import components

# Shingles of several documents are hashed together up to this number.
BLOCK = 1 << 16
# IDs a broadcast may hold, 8 bytes each; a longer list is joined by a shuffle.
BROADCAST_IDS = 1_000_000
# Classes on either side of a tile of a bucket, and pairs that are compared at once.
TILE = 1024
PAIRS = 1 << 13


@dataclass(frozen=True)
class NearDuplicates:
    """Settings: words per shingle, similarity in per cent, bands, samples per band,
    bits of an odd sketch and bins of its samples (powers of two)."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 2048
    bins: int = 1 << 16
    seed: int = 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).integers(0, 2**63, size=count, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text in UTF-8, sorted.

    Words are stretches without [\\x20\\x09-\\x0D], A-Z in lower case. A text with fewer words is one
    shingle; one without words has none. Two different shingles of one pair of documents get
    the same hash with probability below 1e-12, also for a million words.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    factors = _odd_numbers(words + 1, 7)
    count = len(tokens) - width + 1
    total = np.full(count, width, np.uint64) * factors[words]
    for at in range(width):
        total += hashed[at : at + count] * factors[at]
    return np.unique(_mixed(total))


def _band_keys(sets: list[np.ndarray], s: NearDuplicates) -> np.ndarray:
    """Documents x bands."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    factors, shifts = _odd_numbers(s.samples, s.seed), _odd_numbers(s.samples, s.seed + 1)
    least = np.empty((s.samples, len(sets)), np.uint64)
    for i in range(s.samples):
        least[i] = np.minimum.reduceat(every * factors[i] + shifts[i], starts)
    number = np.arange(1, s.samples + 1, dtype=np.uint64)[:, None]
    folded = _mixed(least + number * np.uint64(0x9E3779B97F4A7C15))
    band_factors = _odd_numbers(s.rows, s.seed + 2)[None, :, None]
    keys = (folded.reshape(s.bands, s.rows, -1) * band_factors).sum(axis=1, dtype=np.uint64)
    return np.ascontiguousarray(_mixed(keys).T).view(np.int64)


def odd_sketch(hashes: np.ndarray, s: NearDuplicates) -> tuple[np.ndarray, int]:
    """Parity bitmap of the least hash of every bin, as 64-bit words, and the number of samples.

    The hashes are sorted and their leading bits name the bin, so the first of a bin is the least.
    """
    bins = hashes >> np.uint64(64 - (s.bins - 1).bit_length())
    least = hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]
    bit = (_mixed(least ^ np.uint64(s.seed)) % np.uint64(s.sketch_bits)).astype(np.int64)
    parity = np.bincount(bit, minlength=s.sketch_bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64), len(least)


def _blocks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions of non-empty sets, up to BLOCK hashes at a time."""
    block, size = [], 0
    for at, one in enumerate(sets):
        if len(one):
            if block and size + len(one) > BLOCK:
                yield block
                block, size = [], 0
            block.append(at)
            size += len(one)
    if block:
        yield block


def signatures(docs: DataFrame, settings: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_shingles``, ``set_digest``, ``bands``, ``sketch``, ``samples``; NULL for texts without words."""
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), settings.words) for t in batch.column("text")]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            bands: list = [None] * len(sets)
            for block in _blocks(sets):
                for i, keys in zip(block, _band_keys([sets[i] for i in block], settings)):
                    bands[i] = keys
            folded = [odd_sketch(x, settings) if len(x) else (None, 0) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array([x for x, _ in folded], pa.list_(pa.int64())),
                    pa.array([n for _, n in folded], pa.int32()),
                ],
                names=["id", "n_shingles", "set_digest", "bands", "sketch", "samples"],
            )

    schema = f"id {kind}, n_shingles bigint, set_digest binary, bands array<bigint>, sketch array<bigint>, samples int"
    return source.mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``shingles`` (sorted hashes) of the documents whose ID is listed."""
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = source.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    return wanted.mapInArrow(run, f"id {kind}, shingles array<bigint>")


def _confirmed(pairs: DataFrame, docs: DataFrame, s: NearDuplicates, id_col: str, text_col: str) -> Stage:
    """Of the pairs ``a`` < ``b``, those whose full sets are similar enough."""
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair_ids")
    sets = stage(full_sets(docs, ids.df, s.words, id_col, text_col), "pair_sets")
    side = {x: sets.df.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    joined = pairs.join(side["b"], "b").join(side["a"], "a")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    union = F.size("set_a") + F.size("set_b") - both
    links = stage(joined.where(100 * both >= s.percent * union).select("a", "b"), "pair_links")
    ids.release()
    sets.release()
    return links


SKETCHED = ("n_shingles", "samples", "sketch")


def _pair_limit(s: NearDuplicates, sizes: tuple, kept: tuple, least, greatest, exp, sqrt) -> tuple:
    """Whether the sizes of two sets allow the threshold, and the XOR count their sketches may reach.

    Of all samples of such a pair, ``share / (1 + share)`` are common. Where samples were drawn,
    six deviations of the draw are allowed; where every hash is a sample there are none. Bits
    only cancel out, so the XOR count never exceeds the number of differing samples, and
    stays within six deviations of what so many flips leave. Sizes and numbers of samples are
    columns or arrays of doubles.
    """
    n, share = float(s.sketch_bits), s.percent / 100
    both = kept[0] + kept[1]
    drawn = 1 - least(kept[0] / sizes[0], kept[1] / sizes[1])
    common = share / (1 + share) * both - 6 * sqrt(share * (1 - share) / (1 + share) * both * drawn)
    flips = both - 2 * common
    left = exp(-4 / n * flips)
    spread = sqrt(greatest(n / 4 * (1 - left) - flips * left, 1.0))
    limit = least(flips + 1e-6, n / 2 * (1 - sqrt(left)) + 6 * spread)
    return least(*sizes) >= share * greatest(*sizes), limit


def sketches_close(s: NearDuplicates, a: str = "_a", b: str = "_b") -> Column:
    """Whether two sketches may belong to a pair at or above the threshold."""
    sizes, kept = [tuple(F.col(f"{c}{x}").cast("double") for x in (a, b)) for c in ("n_shingles", "samples")]
    fits, limit = _pair_limit(s, sizes, kept, F.least, lambda x, y: F.greatest(x, F.lit(y)), F.exp, F.sqrt)
    words = [
        F.bit_count(F.get(f"sketch{a}", F.lit(i)).bitwiseXOR(F.get(f"sketch{b}", F.lit(i))))
        for i in range(s.sketch_bits // 64)
    ]
    return fits & (sum(words[1:], words[0]) <= limit)


def _sides(df: DataFrame, *columns: str) -> list[DataFrame]:
    """The table twice, columns ending in _a and in _b."""
    return [df.select(*[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab"]


def _bucket_members(reps: DataFrame) -> Stage:
    """``band``, ``id``, ``weight`` of classes that share a bucket; the weight is how much they share."""
    banded = reps.select("id", F.explode("bands").alias("band"))
    shared = stage(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared_bands")
    rows = stage(banded.join(shared.df, "band").select("band", "id", "n"), "banded")
    weights = stage(rows.df.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    members = stage(rows.df.join(weights.df, "id").select("band", "id", "weight"), "bucket_members")
    for s in (shared, rows, weights):
        s.release()
    return members


def _star_pairs(reps: DataFrame, members: DataFrame, s: NearDuplicates) -> Stage:
    """Per class the head of most of its buckets, if the sketches are close."""
    rank = F.struct("weight", (-F.col("id")).alias("id"))
    heads = members.groupBy("band").agg(F.max(rank).alias("top")).select("band", (-F.col("top.id")).alias("head"))
    heads = stage(heads, "bucket_heads")
    votes = members.join(heads.df, "band").where("id <> head").groupBy("id", "head").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("head")).alias("head"))).alias("top"))
    chosen = best.select(F.col("id").alias("id_b"), (-F.col("top.head")).alias("id_a"))
    side_a, side_b = _sides(reps, "id", *SKETCHED)
    close = chosen.join(side_b, "id_b").join(side_a, "id_a").where(sketches_close(s))
    ends = F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")
    pairs = stage(close.select(*ends).distinct(), "star_pairs")
    heads.release()
    return pairs


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by tile, in batches that hold all rows of each of their tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            tiles = batch.column("tile").to_numpy()
            last = int(np.searchsorted(tiles, tiles[-1]))
            if last or held and held[0].column("tile")[0].as_py() != tiles[-1]:
                yield from pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
                held = []
            held.append(batch.slice(last))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _pairs_of_tiles(tiles: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of every row of side a with every row of side b of its tile, about PAIRS at a time."""
    first, second = np.flatnonzero(in_a), np.flatnonzero(in_b)
    starts = np.searchsorted(tiles[second], tiles[first], "left")
    counts = np.searchsorted(tiles[second], tiles[first], "right") - starts
    ends = np.cumsum(counts)
    at = 0
    while at < len(first):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = counts[at:to]
        within = np.arange(ends[to - 1] - done) - np.repeat(ends[at:to] - n - done, n)
        yield np.repeat(first[at:to], n), second[np.repeat(starts[at:to], n) + within]
        at = to


def _close_across(tiled: DataFrame, s: NearDuplicates) -> DataFrame:
    """``id_a``, ``id_b``: pairs of side a and side b of a tile, of different components, with close sketches.

    Two rows outside the main component meet twice and count once, by their hash.
    """
    kind = tiled.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_tiles(batches):
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "in_a", "in_b", "outside", "hash")}
            size, kept = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_shingles", "samples"))
            component = batch.column("component").dictionary_encode().indices.to_numpy()
            sketch = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, s.sketch_bits // 64)
            for a, b in _pairs_of_tiles(column["tile"], column["in_a"], column["in_b"]):
                once = ~column["outside"][b] | (column["hash"][a] <= column["hash"][b])
                apart = once & (component[a] != component[b])
                a, b = a[apart], b[apart]
                fits, limit = _pair_limit(s, (size[a], size[b]), (kept[a], kept[b]), np.minimum, np.maximum, np.exp, np.sqrt)
                a, b, limit = a[fits], b[fits], limit[fits]
                close = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.uint32) <= limit
                if close.any():
                    ids = [batch.column("id").take(pa.array(x[close])) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays(ids, names=["id_a", "id_b"])

    return tiled.mapInArrow(run, f"id_a {kind}, id_b {kind}")


def _cross_pairs(reps: DataFrame, members: DataFrame, comps: DataFrame, s: NearDuplicates) -> DataFrame:
    """Pairs of one bucket in different components with close sketches.

    At least one class of such a pair lies outside the largest component of its bucket, so
    only those classes are compared with the others. Their blocks times the blocks of all
    classes make the tiles of the bucket; a bucket of up to TILE classes is one tile.
    """
    placed = members.select("band", "id").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = stage(placed.select("band", "id", F.coalesce("component", "id").alias("component")), "placed").df
    counts = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    top = counts.groupBy("band").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("components"), F.sum("n").alias("n")
    )
    mixed = top.where("components > 1").select(
        "band",
        F.col("top.component").alias("main"),
        F.ceil((F.col("n") - F.col("top.n")) / TILE).alias("blocks_a"),
        F.ceil(F.col("n") / TILE).alias("blocks_b"),
    )
    mixed = stage(mixed, "mixed_bands").df
    rows = placed.join(mixed, "band").withColumns({"outside": F.expr("component <> main"), "hash": F.xxhash64("id")})
    block = {x: F.pmod("hash", f"blocks_{x}") for x in "ab"}
    down = F.transform(F.sequence(F.lit(0), F.col("blocks_a") - 1), lambda i: F.struct(i.alias("i"), block["b"].alias("j")))
    along = F.transform(F.sequence(F.lit(0), F.col("blocks_b") - 1), lambda j: F.struct(block["a"].alias("i"), j.alias("j")))
    tiles = F.when(F.col("outside"), F.array_union(down, along)).otherwise(down)
    sent = rows.select("*", F.inline(tiles)).select(
        F.xxhash64("band", "i", "j").alias("tile"),
        (F.col("outside") & (F.col("i") == block["a"])).alias("in_a"),
        (F.col("j") == block["b"]).alias("in_b"),
        "outside",
        "hash",
        "id",
        "component",
    )
    tiled = sent.join(reps.select("id", *SKETCHED), "id").repartition("tile").sortWithinPartitions("tile")
    close = _close_across(tiled, s)
    return close.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, settings: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``class_id``.

    ``class_id`` is the smallest ID with the same set. A text without words (NULL, empty or white
    space only) is its own component. Rows that share an ID are one document, linked through
    any of its texts. A row without an ID is compared with nothing: its component is NULL and
    it is kept. Repeated rows give repeated lines. No documents give no rows.
    """
    s = settings
    ship_package(docs.sparkSession)
    signed = stage(signatures(docs, s, id_col, text_col), "signatures")
    with_words = signed.df.where(F.col("id").isNotNull() & F.col("set_digest").isNotNull())
    classes = stage(with_words.groupBy("set_digest").agg(F.min("id").alias("class_id")), "classes").df
    speaks = with_words.join(classes.withColumnRenamed("class_id", "id"), ["set_digest", "id"], "left_semi")
    reps = stage(speaks.dropDuplicates(["set_digest", "id"]).select("id", "bands", *SKETCHED), "class_reps")

    members = _bucket_members(reps.df)
    star = _star_pairs(reps.df, members.df, s)
    links = _confirmed(star.df, docs, s, id_col, text_col)
    first = components(links.df)
    cross = stage(_cross_pairs(reps.df, members.df, first.df, s).join(star.df, ["a", "b"], "left_anti"), "cross_pairs")
    members.release()
    more = _confirmed(cross.df, docs, s, id_col, text_col)
    last = components(first.df.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.df))
    reps.release()

    final = last.df.select(F.col("node").alias("class_id"), "component")
    keyed = signed.df.select("id", "n_shingles", "set_digest")
    # Two narrow joins; the tables on the right have a row per class, and a class that many
    # rows share is split.
    named = keyed.join(classes, "set_digest", "left")
    joined = named.join(final, "class_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class_id", "id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.coalesce("class_id", "id").alias("class_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, settings: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that stay, with all their columns: the smallest ID of each component."""
    marks = near_duplicates(docs, settings, id_col, text_col)
    gone = broadcast_if_small(stage(marks.where("not kept").select("doc_id").distinct(), "near_gone").df)
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")

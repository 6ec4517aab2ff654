"""Large JSON array files, read in many tasks.

A file is cut into byte ranges. Whether a range begins inside a string, and how deep, hangs
on all that stands before it: so each task first counts the quotes of its range, and the
change of depth under both assumptions; running sums over the ranges of a file, one narrow
row each, then tell every range its state. With it each task reads the records that begin in
its range, the last of them beyond its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.plans.materialize import materialize
from corpusmill.sources.corpus import plain_path
from corpusmill.sources.sinks import open_filesystem

RANGE_BYTES = 32 << 20
# A record that crosses the end of its range is read on in steps of so many bytes.
MORE_BYTES = 1 << 20
RECORDS_AT_A_TIME = 1_000
QUOTE, BACKSLASH = ord('"'), ord("\\")


def unescaped_quotes(raw: np.ndarray) -> np.ndarray:
    """Places of the quotes that no odd run of backslashes precedes; ``raw`` must not begin within such a run."""
    quotes = np.flatnonzero(raw == QUOTE)
    if not len(quotes) or not (raw == BACKSLASH).any():
        return quotes
    # Length of the run of backslashes that ends before each place.
    other = np.where(raw != BACKSLASH, np.arange(len(raw)), -1)
    last_other = np.maximum.accumulate(other)
    before = np.where(quotes > 0, quotes - 1 - np.where(quotes > 0, last_other[quotes - 1], -1), 0)
    return quotes[before % 2 == 0]


def depth_changes(raw: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, +1 or -1) of the brackets outside strings, and whether the end is inside one."""
    quotes = unescaped_quotes(raw)
    opens = (raw == ord("{")) | (raw == ord("["))
    closes = (raw == ord("}")) | (raw == ord("]"))
    places = np.flatnonzero(opens | closes)
    within = (np.searchsorted(quotes, places) + inside) % 2 == 1
    places = places[~within]
    return places, np.where(opens[places], 1, -1), bool((len(quotes) + inside) % 2)


def _settled(file, at: int, size: int) -> int:
    """The first place from ``at`` on that no backslash precedes."""
    while 0 < at < size:
        around = file.read_at(4096, at - 1)
        run = len(around) - len(around.lstrip(b"\\"))
        at += run
        if run < len(around):
            break
    return min(at, size)


def _bytes(file, start: int, end: int) -> np.ndarray:
    return np.frombuffer(file.read_at(end - start, start), np.uint8)


def _ranges(spark: SparkSession, path: str | list[str], glob: str | None, range_bytes: int) -> DataFrame:
    """(path, size, start): one row per byte range; contents are not read."""
    reader = spark.read.format("binaryFile")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    return listed.select(plain_path("path").alias("path"), F.col("length").alias("size"), F.explode(starts).alias("start"))


def _summaries(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """Quotes of each range, and its change of depth if it begins outside or inside a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                system, place = open_filesystem(path)
                with system.open_input_file(place) as file:
                    raw = _bytes(file, _settled(file, start, size), _settled(file, start + range_bytes, size))
                out, into = (int(depth_changes(raw, inside)[1].sum()) for inside in (False, True))
                rows.append((path, size, start, len(unescaped_quotes(raw)), out, into))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    names = ["path", "size", "start", "quotes", "outside", "inside"]
    schema = "path string, size bigint, start bigint, quotes bigint, outside bigint, inside bigint"
    return ranges.mapInArrow(run, schema)


def _states(summaries: DataFrame) -> DataFrame:
    """Each range with whether it begins inside a string, and how deep."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    known = summaries.withColumn("in_string", inside)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum(change).over(earlier), F.lit(0)).cast("bigint")
    return known.select("path", "size", "start", "in_string", depth.alias("depth"))


def _records_of(file, size: int, start: int, end: int, inside: bool, depth: int) -> Iterator[bytes]:
    """Records, elements of the outermost array, whose first bracket lies in the range."""
    begin, limit = _settled(file, start, size), _settled(file, end, size)
    if depth == 0 and start == 0:
        head = file.read_at(min(64, size), 0)
        if not bytes(head).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
            raise ValueError("the file does not begin with a JSON array")
    raw = _bytes(file, begin, limit)
    places, changes, inside = depth_changes(raw, inside)
    depths = depth + np.cumsum(changes)
    begins, closes = places[(changes == 1) & (depths == 2)], places[(changes == -1) & (depths == 1)]
    # The first end may be that of a record which an earlier range reads.
    closes = closes[closes > begins[0]] if len(begins) else closes[:0]
    data = raw.tobytes()
    for first, last in zip(begins, closes):
        yield data[first : last + 1]
    if len(begins) == len(closes):
        return
    held, depth, begin = [data[begins[-1] :]], int(depths[-1]), limit
    while begin < size:
        more = _settled(file, begin + MORE_BYTES, size)
        raw = _bytes(file, begin, more)
        places, changes, inside = depth_changes(raw, inside)
        depths = depth + np.cumsum(changes)
        ends = places[depths == 1]
        data = raw.tobytes()
        if len(ends):
            yield b"".join(held) + data[: ends[0] + 1]
            return
        held.append(data)
        depth, begin = int(depths[-1]) if len(depths) else depth, more
    raise ValueError("the file ends within a record")


def json_records(spark: SparkSession, path: str | list[str], glob: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): the text of every object in the arrays of the files.

    Elements that are neither objects nor arrays are passed over. An empty array has no rows;
    a file that holds no array fails.
    """
    ranges = _ranges(spark, path, glob, range_bytes)
    spread = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    states = materialize(_states(_summaries(spread, range_bytes)))
    n_ranges = states.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, size, start, inside, depth in zip(*[c.to_pylist() for c in batch.columns]):
                system, name = open_filesystem(place)
                with system.open_input_file(name) as file:
                    rows: list[str] = []
                    for record in _records_of(file, size, start, start + range_bytes, inside, depth):
                        rows.append(record.decode())
                        if len(rows) >= RECORDS_AT_A_TIME:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    # As many tasks as ranges, up to what the scheduler takes well.
    return states.repartition(min(max(n_ranges, 1), 100_000), "path", "start").mapInArrow(run, "value string")


def read_json_arrays(
    spark: SparkSession, path: str | list[str], schema: StructType | str, glob: str | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Rows of ``schema`` from files that each hold one JSON array of objects; order is not kept."""
    records = json_records(spark, path, glob, range_bytes)
    return records.select(F.from_json("value", schema).alias("_row")).select("_row.*")

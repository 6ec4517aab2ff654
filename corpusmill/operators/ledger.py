"""A ledger of finished IDs, so that a resumed run shuffles no text.

The IDs are a table bucketed by ID. Beside it stands a Bloom filter, a table of words of 64
bits that is joined by broadcast: a text whose ID the filter does not know is pending and
stays where it is read. Of the others only the IDs are compared with the ledger, whose side
of the join needs no shuffle; the few that the filter mistook are fetched by broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusmill.plans.materialize import broadcast_if_small, materialize

WORD_BITS = 64


@dataclass(frozen=True)
class Ledger:
    """Done IDs under ``path``; ``buckets`` and ``bits`` are those it was created with."""

    spark: SparkSession
    path: str
    id_col: str
    id_type: str
    buckets: int
    bits: int
    hashes: int

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, id_col: str = "file_id", id_type: str = "string", buckets: int = 64,
        bits: int = 1 << 24, hashes: int = 3,
    ) -> Ledger:
        """An empty ledger. Of 2^24 bits and three hashes, 2 million IDs leave 3 percent unsure."""
        row = [(id_col, id_type, buckets, bits, hashes)]
        fields = "id_col string, id_type string, buckets int, bits bigint, hashes int"
        spark.createDataFrame(row, fields).coalesce(1).write.parquet(f"{path}/settings")
        return cls(spark, path, *row[0])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger at ``path`` with its own settings."""
        return cls(spark, path, *spark.read.parquet(f"{path}/settings").first())

    def _places(self) -> list[Column]:
        name = F.col(f"`{self.id_col}`")
        return [F.pmod(F.xxhash64(F.lit(seed), name), F.lit(self.bits)) for seed in range(self.hashes)]

    def _words(self, ids: DataFrame) -> DataFrame:
        """(word, mask) of the bits that the IDs set."""
        set_bits = ids.select(F.explode(F.array(*self._places())).alias("bit"))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % WORD_BITS).cast("int"))
        word = F.floor(F.col("bit") / WORD_BITS).cast("bigint")
        return set_bits.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask"))

    def _table(self) -> str:
        """A catalog name for the bucketed files; drop it after use."""
        name = f"ledger_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (`{self.id_col}` {self.id_type}) USING parquet "
            f"CLUSTERED BY (`{self.id_col}`) SORTED BY (`{self.id_col}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/ids'"
        )
        return name

    def add(self, done: DataFrame) -> None:
        """Enter the IDs of ``done`` that are not in the ledger yet; NULL is no ID."""
        name = self._table()
        try:
            column = F.col(f"`{self.id_col}`")
            fresh = done.select(column.cast(self.id_type).alias(self.id_col)).where(column.isNotNull()).distinct()
            # Written apart first: a table cannot be read and appended to at once.
            new = materialize(fresh.join(self.spark.table(name), self.id_col, "left_anti"))
            (
                new.repartition(self.buckets, column)
                .write.format("parquet")
                .mode("append")
                .option("path", f"{self.path}/ids")
                .bucketBy(self.buckets, self.id_col)
                .sortBy(self.id_col)
                .saveAsTable(name)
            )
            self._words(new).write.mode("append").parquet(f"{self.path}/bloom")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def ids(self) -> tuple[DataFrame, str]:
        """All done IDs as a bucketed table, and the catalog name to drop."""
        name = self._table()
        return self.spark.table(name), name

    def _filter(self) -> DataFrame | None:
        try:
            parts = self.spark.read.schema("word bigint, mask bigint").parquet(f"{self.path}/bloom")
        except AnalysisException:
            return None
        return materialize(parts.groupBy("word").agg(F.bit_or("mask").alias("mask")))

    def unsure(self, texts: DataFrame, flag: str = "_unsure") -> DataFrame:
        """``texts`` with a flag: false where the ID is certainly not in the ledger."""
        words = self._filter()
        if words is None:
            return texts.withColumn(flag, F.lit(False))
        out, known = texts, []
        for i, place in enumerate(self._places()):
            # At most ``bits`` / 64 words.
            part = F.broadcast(words.select(F.col("word").alias(f"_word{i}"), F.col("mask").alias(f"_mask{i}")))
            keyed = out.withColumns({f"_at{i}": F.floor(place / WORD_BITS).cast("bigint"), f"_bit{i}": (place % WORD_BITS).cast("int")})
            out = keyed.join(part, F.col(f"_at{i}") == F.col(f"_word{i}"), "left")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(f"_bit{i}"))
            known.append(F.coalesce(F.col(f"_mask{i}").bitwiseAND(bit) != 0, F.lit(False)))
        return out.select(*[F.col(f"`{c}`") for c in texts.columns], reduce(Column.__and__, known).alias(flag))

    def pending(self, texts: DataFrame) -> DataFrame:
        """The texts whose ID is not in the ledger, rows with a NULL ID among them."""
        marked = self.unsure(texts)
        ids, name = self.ids()
        unsure = marked.where("_unsure").select(f"`{self.id_col}`")
        # Few: the filter's mistakes.
        mistaken = materialize(unsure.join(ids, self.id_col, "left_anti").distinct())
        self.spark.sql(f"DROP TABLE {name}")
        late = texts.join(broadcast_if_small(mistaken), self.id_col, "left_semi")
        return marked.where("not _unsure").drop("_unsure").unionByName(late.select(*texts.columns))

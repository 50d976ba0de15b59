"""The stored keys, laid out so that a probe moves only the candidates.

Two layouts of the same history, both exact:

* ``KeyHistory``: a table bucketed and sorted by the key. Spark deals the candidates into its buckets, and the stored
  side is read where it lies. A join with the whole history costs a scan of the key column, no shuffle of it.
* Day sketches: one blocked Bloom filter for each stored day, as rows ``(first_seen_date, word, bits)``. A key owns one
  64-bit word and five bits of it, so a filter is built by one ``bit_or`` combined map-side and probed by one equality
  join on the word. Only days in which some candidate may lie are read, and what is read decides.

Filters are append-only: each part written is a filter of its own keys, so several parts of one day lose nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "content_hash"
DAY = "first_seen_date"
#: Words of a day's filter: 2**20 words hold four million keys at 16 bits each (about 1 % false hits).
FILTER_WORDS = 1 << 20


# ---------------------------------------------------------------- keys in buckets
@dataclass(frozen=True)
class KeyHistory:
    """Stored keys at ``path``: ``(content_hash, first_seen_at, cycle_id)`` in ``buckets`` buckets of the key.

    The layout is part of the table's definition, which any session derives from ``path`` and ``buckets`` alone. Take at
    least ``spark.sql.shuffle.partitions`` buckets: Spark would shuffle both sides rather than join in fewer tasks.
    """

    spark: SparkSession
    path: str
    buckets: int
    #: A cycle whose own rows do not count: those that a first, failed attempt at it has left.
    besides: str | None = None

    SCHEMA = f"{KEY} string, first_seen_at timestamp_ntz, cycle_id string"

    @property
    def table(self) -> str:
        return "keys_" + hashlib.sha256(f"{self.path}|{self.buckets}".encode()).hexdigest()[:24]

    def _define(self) -> None:
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet
            CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")

    def append(self, rows: DataFrame) -> None:
        """Add rows (``content_hash``, ``first_seen_at``, ``cycle_id``): one file for each bucket, all or nothing."""
        self._define()
        (rows.select(KEY, F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), "cycle_id").repartition(self.buckets, KEY)
             .write.mode("append").format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(self.table))

    def rows(self) -> DataFrame:
        self._define()
        stored = self.spark.table(self.table)
        return stored if self.besides is None else stored.where(~F.col("cycle_id").eqNullSafe(self.besides))

    def holds(self, cycle_id: str) -> bool:
        """Whether a cycle has appended its keys."""
        return not self.rows().where(F.col("cycle_id") == cycle_id).isEmpty()

    def winners(self) -> DataFrame:
        """The unique constraint over overlapping cycles: of rows of one key the first ``(first_seen_at, cycle_id)``
        holds. Decided within the buckets, without an exchange."""
        w = Window.partitionBy(KEY).orderBy("first_seen_at", "cycle_id")
        return self.rows().withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def only_unseen_clustered(candidates: DataFrame, history: KeyHistory, unique: bool = False) -> DataFrame:
    """Candidates whose key is not stored. Null keys are unseen. The stored side is not exchanged.

    With ``unique`` (one candidate a key, as keep-first leaves them) the candidates are dealt into the buckets
    themselves. Else only their distinct keys are, combined map-side, so that a key with a third of all candidates
    reaches no task whole; the candidates then lose the seen keys in a join that AQE can split.
    """
    stored = history.rows().select(KEY)
    if unique:
        return candidates.join(stored, KEY, "left_anti")
    seen = candidates.select(KEY).distinct().join(stored, KEY, "left_semi")
    return candidates.join(seen, KEY, "left_anti")


def accepted(rows: DataFrame, history: KeyHistory) -> DataFrame:
    """The rows a cycle has appended that hold after all: another cycle, overlapping, may have stored a key earlier.

    Readers of the postings and the digest take these instead of the raw append.
    """
    won = history.winners().select(F.col(KEY), F.col("cycle_id").alias("_holder"))
    return rows.join(won, KEY).where(F.col("cycle_id") == F.col("_holder")).drop("_holder")


# ---------------------------------------------------------------- a sketch of each day
def _places(key: str, words: int) -> tuple[str, str]:
    """SQL of the word a key owns and of its five bits."""
    h = f"xxhash64({key})"
    bits = " | ".join(f"shiftleft(bigint(1), int(shiftrightunsigned({h}, {6 * i}) & 63))" for i in range(5))
    return f"int(pmod(shiftrightunsigned({h}, 30), {words}))", bits


def day_filters(rows: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``(content_hash, first_seen_date)`` -> ``(first_seen_date, word, bits)``, at most ``words`` rows a day."""
    word, bits = _places(KEY, words)
    return (rows.where(F.col(KEY).isNotNull()).select(DAY, F.expr(word).alias("word"), F.expr(bits).alias("bits"))
                .groupBy(DAY, "word").agg(F.bit_or("bits").alias("bits")))


def write_day_filters(filters: DataFrame, path: str) -> None:
    """Append a part of the filters; rows of a word lie together."""
    filters.sortWithinPartitions("word").write.mode("append").parquet(path)


def possible_days(candidates: DataFrame, filters: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``(content_hash, first_seen_date)``: the days in which a candidate's key may be stored (never too few)."""
    word, bits = _places(KEY, words)
    keys = candidates.where(F.col(KEY).isNotNull()).select(KEY).distinct().select(KEY, F.expr(word).alias("word"), F.expr(bits).alias("mask"))
    return keys.join(filters, "word").where("bits & mask = mask").select(KEY, DAY).distinct()


def only_unseen_sketched(candidates: DataFrame, stored: DataFrame, filters: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Candidates whose key is not stored. Of ``stored``, partitioned by day, only the days are read in which the
    filters let some candidate lie; the keys read there decide. A day without a filter must not exist in ``stored``.

    The days are collected to prune partitions by literals: as many values as there are days.
    """
    days = [r[0] for r in possible_days(candidates, filters, words).select(DAY).distinct().collect()]
    read = stored.where(F.col(DAY).isin(days)) if days else stored.limit(0)
    return candidates.join(read.select(KEY), KEY, "left_anti")

"""Content key (D1), keep-first (D2), existence probe (J2/D3), insert-if-new (D4), row shape.

Scale notes: keep-first and the anti-join both need the candidates clustered by
``content_hash``; written back to back they share one Exchange, and only the
``content_hash`` column of the stored table is shuffled. ``row_number() == 1``
lets Spark prune each key to one row per map task before the shuffle
(WindowGroupLimit), so a key holding a third of all rows does not reach one task whole.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.text import collapse_ws, cut, first_items, null_if_blank, trim_js, ts_lit
from jobtrail.operators.cuts import Cuts
from jobtrail.operators.history import KeyHistory, only_unseen_clustered

MAX_SUMMARY = 1200
MAX_RAW_TEXT = 14000
MAX_STACK = 20


def key_text(title: Column, company: Column, url: Column) -> Column:
    """What the content key is a hash of: ``lower(title)|lower(company)|lower(url)`` (parts joined unescaped)."""
    return F.concat_ws("|", F.lower(title), F.lower(company), F.lower(url))


def content_key(df: DataFrame, url_fallback: str | None = "source_url") -> DataFrame:
    """``job_url`` = trimmed posting URL or the fallback; ``content_hash`` = sha256 of the key's text."""
    url = trim_js(F.col("job_url"))
    if url_fallback is not None:
        url = F.coalesce(F.nullif(url, F.lit("")), F.col(url_fallback))
    return (df.withColumn("job_url", url)
              .withColumn("content_hash", F.sha2(key_text(F.col("job_title"), F.col("company_name"), F.col("job_url")), 256)))


def keep_first(df: DataFrame, order: list[str], key: str = "content_hash") -> DataFrame:
    """The first row per key under a total order (no ``dropDuplicates``, no unordered ``first``)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def only_unseen(cand: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """Candidates whose key is not stored yet (one set-based probe instead of one per posting).

    An anti-join that reads only the key column of the stored table; whether that column is
    shuffled or broadcast is left to AQE's byte sizes.
    """
    return cand.join(stored.select(key), key, "left_anti")


def posting_rows(df: DataFrame, raw_text_col: str | None = "page_text", max_stack: int | None = MAX_STACK,
                 max_summary: int | None = MAX_SUMMARY, max_raw_text: int | None = MAX_RAW_TEXT) -> DataFrame:
    """Final write shape: trims, stack <= 20, summary collapsed and <= 1200, raw text <= 14000 (None: not cut).

    ``raw_text_col=None``: without the raw text, for rows that get it later.
    """
    return df.select(
        "content_hash", "tracked_url_id",
        trim_js("job_title").alias("job_title"),
        trim_js("company_name").alias("company_name"),
        null_if_blank("salary").alias("salary"),
        first_items(F.coalesce(F.col("tech_stack"), F.array().cast("array<string>")), max_stack).alias("tech_stack"),
        cut(collapse_ws("requirements_summary"), max_summary).alias("requirements_summary"),
        F.col("job_url"),
        *([] if raw_text_col is None else [cut(F.coalesce(F.col(raw_text_col), F.lit("")), max_raw_text).alias("raw_text")]),
        *[c for c in df.columns if c in ("snapshot_id", "added_at", "pos", "cycle_id")],
    )


def insert_new(cand: DataFrame, stored: DataFrame | KeyHistory, order: list[str], cycle_id: str, now: datetime,
               raw_text_col: str | None = "page_text", url_fallback: str | None = "source_url", cuts: Cuts = Cuts()) -> DataFrame:
    """Key -> keep-first -> not stored -> row shape, stamped with the cycle.

    ``stored``: the stored rows, or their keys in buckets, which are then probed in place. Replay-safe:
    once the result is appended, the same input yields nothing.
    """
    keyed = content_key(cand, url_fallback)
    if isinstance(stored, KeyHistory):
        fresh = only_unseen_clustered(keep_first(keyed, order), stored, unique=True)
    else:  # ranked and probed by the key's 32 bytes: its digits take twice as much of a shuffle
        firsts = keep_first(keyed.withColumn("_key", F.unhex("content_hash")).drop("content_hash"), order, "_key")
        digits = F.when(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.col("content_hash"))
        fresh = only_unseen(firsts, stored.select(F.unhex(digits).alias("_key")), "_key").withColumn("content_hash", F.lower(F.hex("_key")))
    rows = posting_rows(fresh, raw_text_col, cuts.stack, cuts.summary, cuts.raw_text)
    return rows.select(
        F.col("content_hash").alias("id"), "*",
        ts_lit(now).alias("first_seen_at"),
        F.lit(cycle_id).alias("cycle_id"),
    )

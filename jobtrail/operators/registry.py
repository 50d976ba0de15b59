"""Source registration and removal: P1-P5, U1-U3.

Registration takes a batch of submissions and returns the new sources table plus
one outcome row per submission. The "first submission per URL wins" rule is an
aggregate (``min(submit_no)`` per canonical URL, combined map-side) joined back on
``(url, submit_no)``, which is unique per row, so a URL submitted a million times
does not land in one task. Spark picks the physical joins from sizes (AQE).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.text import null_if_blank, trim_js, ts_lit
from jobtrail.functions.urls import with_canonical_url
from jobtrail.schemas import SOURCE_TYPES

# Rejection reasons.
URL_REQUIRED = "url is required"
URL_INVALID = "url must be a valid absolute URL"
URL_EXISTS = "URL already exists"
BAD_SOURCE_TYPE = "source_type must be linkedin or company_page"
ID_REQUIRED = "id is required"


def infer_source_type(url: Column, given: Column | None = None) -> Column:
    """``linkedin`` when the URL names linkedin.com anywhere, else ``company_page``; a given type wins."""
    inferred = F.when(url.rlike(r"(?i)linkedin\.com"), F.lit("linkedin")).otherwise(F.lit("company_page"))
    return inferred if given is None else F.coalesce(given, inferred)


def validate_submissions(subs: DataFrame) -> DataFrame:
    """Add ``canonical_url``, ``source_type`` (given or inferred), ``label`` (trimmed or NULL) and ``reason``."""
    url = F.col("url")
    blank = F.coalesce(trim_js(url), F.lit("")) == ""
    d = with_canonical_url(subs, "url", "canonical_url")
    st = infer_source_type(F.col("canonical_url"), F.col("source_type"))
    d = d.withColumns({"source_type": st, "label": null_if_blank("label")})
    reason = (F.when(blank, F.lit(URL_REQUIRED))
               .when(F.col("canonical_url").isNull(), F.lit(URL_INVALID))
               .when(~F.col("source_type").isin(*SOURCE_TYPES), F.lit(BAD_SOURCE_TYPE)))
    return d.withColumn("reason", reason)


def source_id(url: Column) -> Column:
    """Deterministic id derived from the unique URL (replayable, unlike random UUIDs)."""
    return F.substring(F.sha2(url, 256), 1, 32)


def new_source_rows(accepted: DataFrame, now: datetime) -> DataFrame:
    """Rows of the sources table for accepted submissions (P5 defaults)."""
    return accepted.select(
        source_id(F.col("canonical_url")).alias("id"), F.col("canonical_url").alias("url"), "label", "source_type",
        ts_lit(now).alias("added_at"), F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"),
        F.lit("pending").alias("last_scrape_status"))


def register_sources(sources: DataFrame, subs: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Returns ``(new_sources_table, outcomes)``; outcome = created | rejected with a reason."""
    v = validate_submissions(subs)
    ok = v.where(F.col("reason").isNull())
    firsts = ok.groupBy("canonical_url").agg(F.min("submit_no").alias("submit_no"))
    existing = sources.select(F.col("url").alias("canonical_url"), F.lit(True).alias("_exists")).distinct()
    # one row per URL of the batch: its first submission, unless the URL is in the table
    firsts = firsts.join(existing, "canonical_url", "left").where(F.col("_exists").isNull()).select(
        "canonical_url", "submit_no", F.lit(True).alias("_first"))
    marked = v.join(firsts, ["canonical_url", "submit_no"], "left")
    reason = F.coalesce(F.col("reason"),
                        F.when(F.col("_first").isNull(), F.lit(URL_EXISTS)))
    outcomes = marked.withColumn("reason", reason).select(
        "submit_no", F.col("canonical_url").alias("url"), "label", "source_type",
        F.when(F.col("reason").isNull(), F.lit("created")).otherwise(F.lit("rejected")).alias("status"), "reason")
    created = new_source_rows(outcomes.where(F.col("status") == "created").withColumnRenamed("url", "canonical_url"), now)
    return sources.unionByName(created), outcomes


def remove_sources(sources: DataFrame, requests: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Returns ``(remaining_sources, outcomes)``. Unknown ids succeed and change nothing."""
    r = requests.withColumn("_id", F.coalesce(trim_js(F.col(id_col)), F.lit("")))
    outcomes = r.select(F.col("_id").alias("id"),
                        F.when(F.col("_id") == "", F.lit("rejected")).otherwise(F.lit("removed")).alias("status"),
                        F.when(F.col("_id") == "", F.lit(ID_REQUIRED)).alias("reason"))
    ids = r.where(F.col("_id") != "").select(F.col("_id").alias("id")).distinct()
    return sources.join(ids, "id", "left_anti"), outcomes


def cascade_postings(postings: DataFrame, removed_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Postings whose source was removed are dropped (FK ``on delete cascade``)."""
    ids = removed_ids.select(F.col(id_col).alias("tracked_url_id")).distinct()
    return postings.join(ids, "tracked_url_id", "left_anti")

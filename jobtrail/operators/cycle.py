"""One scrape cycle over all sources as one plan: P6, P7, J3, C1-C5.

A row-at-a-time loop over sources would isolate failures with try/catch.
Here every source gets an outcome column instead of an exception, so one plan
covers all sources: route (P6) -> robots gate (R2) -> snapshot metadata (J3) ->
outcome (P7/C1). Successful pages are cleaned once, extracted, and go through
insert-if-new (D4). Precedence between sources is the order key
``(added_at, tracked_url_id, pos)``; no global sort is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.text import cut, ts_lit
from jobtrail.functions.urls import with_canonical_url
from jobtrail.operators.clean import MAX_PAGE_CHARS, clean_pages
from jobtrail.operators.cuts import Cuts
from jobtrail.operators.dedupe import insert_new
from jobtrail.operators.extract import extract_postings
from jobtrail.operators.history import KeyHistory
from jobtrail.operators.robots import ROBOTS_REASON, robots_gate, robots_rules
from jobtrail.sources.workspace import kept, new_folder

# Failure reasons.
INVALID_URL = "Invalid URL"
UNKNOWN_ERROR = "Unknown scrape error"
STATIC_STATUS = "Static scrape failed with status "

PAGE_ORDER = ["added_at", "tracked_url_id", "pos"]


def route_sources(sources: DataFrame) -> DataFrame:
    """``browser`` for LinkedIn sources (by type or by URL), else ``static``."""
    browser = (F.col("source_type") == "linkedin") | F.col("url").rlike(r"(?i)linkedin\.com")
    return sources.withColumn("route", F.when(browser, F.lit("browser")).otherwise(F.lit("static")))


def cycle_pages(sources: DataFrame, snaps: DataFrame) -> DataFrame:
    """Every source with the metadata of its latest snapshot (left join; the HTML is not carried).

    The latest by ``(fetched_at, snapshot_id)``, an aggregate combined map-side: a backlog of several
    snapshots of one source, or copies of one, still gives one row per source.
    """
    meta = F.struct("snapshot_id", "final_url", "http_status", "error")
    latest = snaps.groupBy(F.col("tracked_url_id").alias("id")).agg(F.max_by(meta, F.struct("fetched_at", "snapshot_id")).alias("s"))
    return (sources.join(latest.select("id", "s.*", F.lit(True).alias("has_snapshot")), "id", "left")
                   .withColumn("has_snapshot", F.coalesce("has_snapshot", F.lit(False))))


def classify_fetch(df: DataFrame) -> DataFrame:
    """``status`` and ``reason`` per source, checks in the order the fetch makes them:
    URL parse -> robots -> snapshot present -> fetch error -> HTTP status (static route only)."""
    ok_status = F.col("http_status").between(200, 299)
    reason = (F.when(F.col("canonical_url").isNull(), F.lit(INVALID_URL))
               .when(~F.col("robots_allowed"), F.lit(ROBOTS_REASON))
               .when(~F.col("has_snapshot"), F.lit(UNKNOWN_ERROR))
               .when(F.col("error").isNotNull(), F.col("error"))
               .when((F.col("route") == "static") & ~F.coalesce(ok_status, F.lit(False)),
                     F.concat(F.lit(STATIC_STATUS), F.coalesce(F.col("http_status").cast("string"), F.lit("unknown")))))
    return df.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("success")).otherwise(F.lit("failed")))


def source_outcomes(sources: DataFrame, snaps: DataFrame, robots: DataFrame) -> DataFrame:
    """One row per source: id, url, added_at, route, snapshot_id, final_url, status, reason."""
    src = with_canonical_url(route_sources(sources), "url", "canonical_url")
    gated = robots_gate(src, robots_rules(robots), canon_col="canonical_url")
    return classify_fetch(cycle_pages(gated, snaps)).select(
        "id", "url", "label", "source_type", "added_at", "route", "snapshot_id", "final_url", "status", "reason")


def cycle_failures(outcomes: DataFrame) -> DataFrame:
    """(id, url, reason) of the failed sources."""
    return outcomes.where(F.col("status") == "failed").select("id", "url", "reason", "added_at")


def apply_status(sources: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Sources after the cycle; status and ``last_scraped_at`` set for success and failure alike.

    One outcome per source is enforced: a second one fails the job before anything is written.
    """
    once = outcomes.groupBy("id").agg(F.max("status").alias("status"), F.count("*").alias("n"))
    status = F.when(F.col("n") == 1, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("several outcomes of source "), F.col("id"))))
    o = once.select("id", status.cast("string").alias("_status"))
    j = sources.join(o, "id", "left")
    return j.select(
        "id", "url", "label", "source_type", "added_at",
        F.when(F.col("_status").isNotNull(), ts_lit(now)).otherwise(F.col("last_scraped_at")).alias("last_scraped_at"),
        F.coalesce(F.col("_status"), F.col("last_scrape_status")).alias("last_scrape_status"))


def latest_status(attempts: DataFrame) -> DataFrame:
    """C3 from an attempt log: the last write wins, ordered by ``(ts, event_id)``.

    ``max_by`` is combined map-side, so a source with a third of all attempts is fine.
    """
    return attempts.groupBy("source_id").agg(
        F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last")
    ).select("source_id", F.col("last.status").alias("last_scrape_status"), F.col("last.ts").alias("last_scraped_at"))


def cycle_summary(outcomes: DataFrame, new_rows: DataFrame, started_at: datetime, finished_at: datetime) -> DataFrame:
    """C4: one row of counts. Failures stay a table (C2), referenced by the cycle, not a list in a cell."""
    tagged = outcomes.select(F.col("status").alias("k")).unionByName(new_rows.select(F.lit("new").alias("k")))
    agg = tagged.agg(
        F.count_if(F.col("k") != "new").alias("scanned_count"),
        F.count_if(F.col("k") == "new").alias("new_jobs_count"),
        F.count_if(F.col("k") == "failed").alias("failed_count"),
    )
    return agg.select(
        ts_lit(started_at).alias("started_at"),
        ts_lit(finished_at).alias("finished_at"),
        "scanned_count", "new_jobs_count", "failed_count",
        (F.col("new_jobs_count") > 0).alias("digest_sent"))


@dataclass
class CycleResult:
    outcomes: DataFrame
    pages: DataFrame
    postings: DataFrame
    new_rows: DataFrame
    sources_after: DataFrame


def successful_pages(snaps: DataFrame, outcomes: DataFrame, max_chars: int | None = MAX_PAGE_CHARS) -> DataFrame:
    """The latest snapshots of successful sources, cleaned once. Copies of a snapshot give copies of its
    page, which keep-first drops."""
    ok = outcomes.where(F.col("status") == "success").select(
        F.col("id").alias("tracked_url_id"), "snapshot_id", "added_at", F.col("url").alias("tracked_url"))
    j = snaps.join(ok, ["tracked_url_id", "snapshot_id"])
    j = j.withColumn("source_url", F.coalesce(F.col("final_url"), F.col("tracked_url")))
    return clean_pages(j.select("tracked_url_id", "snapshot_id", "source_url", "added_at", "html"), max_chars=max_chars)


def run_cycle(sources: DataFrame, snaps: DataFrame, robots: DataFrame, replies: DataFrame | None,
              stored: DataFrame | KeyHistory, cycle_id: str, now: datetime, cuts: Cuts = Cuts(), folder: str | None = None) -> CycleResult:
    """The whole cycle. The caller writes ``new_rows`` (S7) first, then ``sources_after`` (S8) and the
    digest (S9); a replay adds nothing.

    Outcomes and clean pages are written to ``folder`` (a new one below the shared folder by default; the caller
    clears it), so each is computed once whatever reads it. Ranking and probing move postings without their page's
    text; the winners fetch it from the written pages.
    """
    folder = folder or new_folder(sources.sparkSession, "cycle")
    outcomes = kept(source_outcomes(sources, snaps, robots), f"{folder}/outcomes")
    pages = kept(successful_pages(snaps, outcomes, cuts.page), f"{folder}/pages")
    postings = extract_postings(pages, replies, cuts=cuts, keep_text=False)
    fresh = insert_new(postings, stored, PAGE_ORDER, cycle_id, now, raw_text_col=None, cuts=cuts)
    texts = pages.select("tracked_url_id", "snapshot_id", cut(F.coalesce("page_text", F.lit("")), cuts.raw_text).alias("raw_text"))
    # copies of a snapshot have copies of its page
    new_rows = fresh.join(texts, ["tracked_url_id", "snapshot_id"]).dropDuplicates(["content_hash"]).drop("snapshot_id")
    return CycleResult(outcomes, pages, postings, new_rows, apply_status(sources, outcomes, now))

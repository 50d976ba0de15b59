"""Search over the stored postings: J1, P8-P12, L1-L3.

The plan is: date filter (pushed into the parquet scan, and partition pruning on
``first_seen_date`` when present) -> top-N by ``first_seen_at`` (TakeOrderedAndProject,
each task keeps N rows) -> join the <= 2000 rows with their sources -> row
normalization -> tech and text filters. The last two run after the limit on purpose:
a search may return fewer rows than match (``filter_first=True`` moves both before it).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.text import JS_WS_CLASS, leading_int, ts_lit

from jobtrail.sources.tables import scan_postings

DEFAULT_LIMIT = 500
MAX_LIMIT = 2000
UI_LIMIT = 1000

# Display defaults.
UNKNOWN_SOURCE = "Unknown source"
NOT_SPECIFIED = "Not specified"
SALARY_NOT_SPECIFIED = "Salary not specified"


# Fixed value: the ECMAScript whitespace set used by String.prototype.trim.
_JS_WS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


# ---------------------------------------------------------------- L2 (driver-side parameter rules)
def clamp_limit(raw: str | None) -> int:
    """Leading integer of the text; <= 0 or none -> 500; at most 2000."""
    m = re.match(r"([+-]?[0-9]+)", (raw or "").lstrip(_JS_WS))
    n = int(m.group(1)) if m else 0
    return min(n, MAX_LIMIT) if n > 0 else DEFAULT_LIMIT


def limit_of(raw: Column) -> Column:
    """``clamp_limit`` as a column: the same rule for a table of requests. NULL and text without a number give 500."""
    n = leading_int(raw)
    huge = raw.rlike("^" + JS_WS_CLASS + r"*\+?0*[1-9][0-9]{18,}")  # beyond 64 bits
    return F.when(huge, F.lit(MAX_LIMIT)).when(n > 0, F.least(n, F.lit(MAX_LIMIT))).otherwise(F.lit(DEFAULT_LIMIT)).cast("long")


def _parse_day(raw: str | None) -> datetime | None:
    """``YYYY``, ``YYYY-MM`` (their first day) or ``YYYY-MM-DD``; None for anything else."""
    if not raw or not re.fullmatch(r"[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?", raw):
        return None
    try:
        return datetime.strptime((raw + "-01-01")[:10], "%Y-%m-%d")
    except ValueError:
        return None


def day_start(raw: str | None) -> datetime | None:
    """UTC start of the day, or None (filter ignored) when the text is not a valid date."""
    return _parse_day(raw)


def day_end(raw: str | None) -> datetime | None:
    """UTC ``23:59:59.999`` of the day (inclusive bound), or None."""
    d = _parse_day(raw)
    return None if d is None else d + timedelta(hours=23, minutes=59, seconds=59, milliseconds=999)


# ---------------------------------------------------------------- P8
def date_range(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "first_seen_at") -> DataFrame:
    lo, hi = day_start(start), day_end(end)
    if lo is not None:
        df = df.where(F.col(col) >= ts_lit(lo))
        if "first_seen_date" in df.columns:
            df = df.where(F.col("first_seen_date") >= F.lit(lo.date()))
    if hi is not None:
        df = df.where(F.col(col) <= ts_lit(hi))
        if "first_seen_date" in df.columns:
            df = df.where(F.col("first_seen_date") <= F.lit(hi.date()))
    return df


# ---------------------------------------------------------------- P9 / P10
def _needle(raw: str | None) -> str:
    return (raw or "").strip(_JS_WS).lower()


def tech_filter(df: DataFrame, needle: str | None, col: str = "tech_stack") -> DataFrame:
    """Some stack entry contains the needle (case-insensitive, literal)."""
    n = _needle(needle)
    if not n:
        return df
    return df.where(F.exists(F.col(col), lambda e: F.contains(F.lower(e), F.lit(n))))


def haystack(company: Column, title: Column, url: Column, label: Column) -> Column:
    """Company, title, source URL and label joined by single spaces, NULL as ''."""
    parts = [F.coalesce(c, F.lit("")) for c in (company, title, url, label)]
    return F.lower(F.concat_ws(" ", *parts))


def text_filter(df: DataFrame, needle: str | None) -> DataFrame:
    """The haystack contains the needle (literal, may span two fields)."""
    n = _needle(needle)
    if not n:
        return df
    hs = haystack(F.col("company_name"), F.col("job_title"), F.col("tracked_urls.url"), F.col("tracked_urls.label"))
    return df.where(F.contains(hs, F.lit(n)))


# ---------------------------------------------------------------- P10 over a long history
def trigram_index(jobs: DataFrame) -> DataFrame:
    """``jobs`` with their sources (J1) -> ``(content_hash, first_seen_date, trigrams)``: the distinct runs of three
    characters of the haystack, one row a posting. Write it next to the postings, appended with them."""
    hs = haystack(F.col("company_name"), F.col("job_title"), F.col("tracked_urls.url"), F.col("tracked_urls.label"))
    cut_ = F.expr("array_distinct(transform(sequence(1, greatest(1, length(_hs) - 2)), i -> substring(_hs, i, 3)))")
    return jobs.select("content_hash", "first_seen_date", hs.alias("_hs")).select("content_hash", "first_seen_date", cut_.alias("trigrams"))


def text_candidates(index: DataFrame, needle: str) -> DataFrame | None:
    """``(content_hash, first_seen_date)`` of the postings that hold all trigrams of the needle (none is missed).

    How many postings hold each is counted first, so the rarest is tested first and most rows end there; nothing is
    shuffled. None for a needle of fewer than three characters, which no trigram narrows down.
    """
    n = _needle(needle)
    grams = sorted({n[i: i + 3] for i in range(len(n) - 2)})
    if not grams:
        return None
    holds = [F.array_contains("trigrams", g) for g in grams]
    counts = index.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(holds)]).first()  # one row
    for i in sorted(range(len(grams)), key=lambda i: (counts[i], grams[i])):
        index = index.where(holds[i])
    return index.select("content_hash", "first_seen_date")


def text_search(jobs: DataFrame, sources: DataFrame, index: DataFrame, needle: str) -> DataFrame:
    """``text_filter`` over a stored history with a trigram index: of ``jobs``, partitioned by day, only days with a
    candidate are read, and only candidates meet their sources and the exact test. The days are pruned by literals."""
    found = text_candidates(index, needle)
    if found is not None:
        days = [r[0] for r in found.select("first_seen_date").distinct().collect()]  # as many as there are days
        jobs = jobs.where(F.col("first_seen_date").isin(days)) if days else jobs.limit(0)
        jobs = jobs.join(found, ["content_hash", "first_seen_date"], "left_semi")
    return text_filter(with_source(jobs, sources), needle)


# ---------------------------------------------------------------- J1
def with_source(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Embed the source as a nullable struct ``tracked_urls(url, label, source_type)`` (left join)."""
    s = sources.select(F.col("id").alias("_sid"),
                       F.struct("url", "label", "source_type").alias("tracked_urls"))
    return jobs.join(s, jobs["tracked_url_id"] == s["_sid"], "left").drop("_sid")


# ---------------------------------------------------------------- P11 / P12
def normalize_result(df: DataFrame) -> DataFrame:
    """Row shape of the search answer: NULL text -> '', falsy salary -> NULL, empty stack entries dropped."""
    text = ["id", "tracked_url_id", "job_title", "company_name", "requirements_summary", "job_url", "raw_text", "content_hash"]
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text if c in df.columns}
    cols["salary"] = F.nullif(F.col("salary"), F.lit(""))
    cols["tech_stack"] = F.filter(F.transform(F.coalesce(F.col("tech_stack"), F.array().cast("array<string>")),
                                              lambda e: F.coalesce(e, F.lit("null"))), lambda e: e != "")
    return df.withColumns(cols)


def display_view(df: DataFrame) -> DataFrame:
    """Display strings of a result row (source, salary, stack)."""
    return df.withColumns({
        "source_display": F.coalesce(F.nullif(F.col("tracked_urls.label"), F.lit("")),
                                     F.nullif(F.col("tracked_urls.url"), F.lit("")), F.lit(UNKNOWN_SOURCE)),
        "salary_display": F.coalesce(F.nullif(F.col("salary"), F.lit("")), F.lit(SALARY_NOT_SPECIFIED)),
        "tech_display": F.when(F.size("tech_stack") > 0, F.col("tech_stack")).otherwise(F.array(F.lit(NOT_SPECIFIED))),
    })


# ---------------------------------------------------------------- L1
def newest(jobs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most recent postings (ties by content_hash for a stable answer)."""
    return jobs.orderBy(F.col("first_seen_at").desc(), F.col("content_hash").asc()).limit(limit)


# ---------------------------------------------------------------- L3
def search(jobs: DataFrame, sources: DataFrame, tech: str | None = None, company_or_source: str | None = None,
           start_date: str | None = None, end_date: str | None = None, limit: str | int | None = None,
           columns: list[str] | None = None, filter_first: bool = False) -> DataFrame:
    """The search answer, newest first. ``columns`` prunes the scan (``raw_text`` is wide).

    ``filter_first``: both filters run before the limit, so no match behind it is lost.
    """
    n = clamp_limit(str(limit) if limit is not None else None)
    base = date_range(scan_postings(jobs, columns), start_date, end_date)
    if not filter_first:
        base = newest(base, n)
    out = text_filter(tech_filter(normalize_result(with_source(base, sources)), tech), company_or_source).drop("first_seen_date")
    return newest(out, n) if filter_first else out.orderBy(F.col("first_seen_at").desc(), F.col("content_hash").asc())

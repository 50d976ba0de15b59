"""Table schemas (FIXTURES.md section 1). Timestamps are ``timestamp_ntz`` in UTC."""

from pyspark.sql import types as T

TS = T.TimestampNTZType()

SOURCES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("added_at", TS, False),
    T.StructField("last_scraped_at", TS, True),
    T.StructField("last_scrape_status", T.StringType(), False),
])

POSTINGS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("tracked_url_id", T.StringType(), False),
    T.StructField("job_title", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("salary", T.StringType(), True),
    T.StructField("tech_stack", T.ArrayType(T.StringType(), False), False),
    T.StructField("requirements_summary", T.StringType(), False),
    T.StructField("job_url", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("first_seen_at", TS, False),
    T.StructField("cycle_id", T.StringType(), True),
    T.StructField("first_seen_date", T.DateType(), True),
])

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_id", T.StringType(), False),
    T.StructField("tracked_url_id", T.StringType(), False),
    T.StructField("fetched_at", TS, False),
    T.StructField("final_url", T.StringType(), True),
    T.StructField("html", T.StringType(), True),
    T.StructField("http_status", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
])

ROBOTS = T.StructType([
    T.StructField("origin", T.StringType(), False),
    T.StructField("http_status", T.IntegerType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("fetched_at", TS, False),
])

REPLIES = T.StructType([
    T.StructField("snapshot_id", T.StringType(), False),
    T.StructField("raw_content", T.StringType(), True),
    T.StructField("replied_at", TS, False),
])

SUBMISSIONS = T.StructType([
    T.StructField("submit_no", T.LongType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("source_type", T.StringType(), True),
])

SOURCE_TYPES = ("linkedin", "company_page")
SCRAPE_STATUSES = ("success", "failed", "pending")

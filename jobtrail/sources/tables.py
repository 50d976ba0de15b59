"""Landing tables in, history tables out.

Everything is plain parquet. Postings are append-only and partitioned by
``first_seen_date`` (the search predicate prunes partitions); the sources table
is written as a new ``version`` partition per cycle and read at its newest
version, so a cycle never overwrites a path it is reading. Old versions expire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail import schemas
from jobtrail.sources.landing import read_landed, stream_landed
from jobtrail.sources.workspace import drop_folder


#: Compression of the stored history: keys are hexadecimal digits, which need entropy coding to shrink.
STORED = "zstd"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given test tables, e.g. ``pages`` or ``lineitem``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders right below ``path``, on any file system Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def source_versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Versions of the sources table and the cycle that wrote each ('' for none), from the folder listing."""
    found = {}
    for name in _folders(spark, path):
        if name.startswith("version="):
            number = int(name.removeprefix("version="))
            cycles = [c.removeprefix("cycle_id=") for c in _folders(spark, f"{path.rstrip('/')}/{name}") if c.startswith("cycle_id=")]
            found[number] = cycles[0] if cycles else ""
    return found


def read_sources(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Newest version of the sources table (S1/S2 scan), or the newest one before ``before``.

    The version is a literal taken from the folder listing, so the scan is pruned to its partition.
    """
    df = spark.read.parquet(path)
    if "version" not in df.columns:
        return df
    newest = max(v for v in source_versions(spark, path) if before is None or v < before)
    return df.where(F.col("version") == newest).drop("version", "cycle_id")


POSTING_COLUMNS = ["id", "tracked_url_id", "job_title", "company_name", "salary", "tech_stack",
                   "requirements_summary", "job_url", "raw_text", "content_hash", "first_seen_at"]


def list_sources(sources: DataFrame) -> DataFrame:
    """All sources, newest first (ties by id)."""
    return sources.orderBy(F.col("added_at").desc(), F.col("id").asc())


def cycle_sources(sources: DataFrame) -> DataFrame:
    """Sources for a cycle. Precedence travels as the ``(added_at, id)`` key on every row
    (later steps order within their own groups); no global sort."""
    return sources.select("id", "url", "label", "source_type", "added_at")


def scan_postings(jobs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """S3: postings with an explicit column list, so the parquet scan reads only those columns
    (``raw_text`` is the wide one), plus the day partition column when present."""
    cols = [c for c in (columns or POSTING_COLUMNS) if c in jobs.columns]
    return jobs.select(*cols, *[c for c in ("first_seen_date",) if c in jobs.columns and c not in cols])


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page snapshots landed by the fetcher (S4); ``fmt="json"``: one record a line, see ``landing``."""
    return read_landed(spark, path, schemas.SNAPSHOTS, fmt)


def stream_snapshots(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Snapshots as a stream: each new file is picked up once."""
    return stream_landed(spark, path, schemas.SNAPSHOTS, fmt, max_files_per_trigger)


def read_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Robots bodies per origin."""
    return read_landed(spark, path, schemas.ROBOTS, fmt)


def read_replies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Model replies per snapshot, raw text."""
    return read_landed(spark, path, schemas.REPLIES, fmt)


def write_postings(df: DataFrame, path: str) -> None:
    """Append new postings (S7). Partitioned by day so date filters prune files."""
    (df.withColumn("first_seen_date", F.to_date("first_seen_at"))
       .write.mode("append").option("compression", STORED).partitionBy("first_seen_date").parquet(path))


def remove_postings(spark: SparkSession, path: str, gone: DataFrame) -> list[str]:
    """U3 on the stored table: delete the postings of the sources ``gone (id)``; returns the days rewritten.

    Only days that hold such a posting are read in full and overwritten (dynamic partition overwrite, committed as
    one); the files of all other days stay as they are. The affected days are found by a scan of two narrow columns.
    """
    stored = spark.read.parquet(path)
    hit = stored.join(gone.select(F.col("id").alias("tracked_url_id")), "tracked_url_id", "left_semi")
    days = [r[0] for r in hit.select("first_seen_date").distinct().collect()]  # as many as there are days
    if not days:
        return []
    remaining = stored.where(F.col("first_seen_date").isin(days)).join(
        gone.select(F.col("id").alias("tracked_url_id")), "tracked_url_id", "left_anti").select(stored.columns)
    # a day of which nothing remains is not among the rows to write: its folder goes
    left = {r[0] for r in remaining.select("first_seen_date").distinct().collect()}
    # the old files of a day stay until the new ones are complete, so they can be read meanwhile
    (remaining.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", STORED)
              .partitionBy("first_seen_date").parquet(path))
    for day in set(days) - left:
        drop_folder(spark, f"{path.rstrip('/')}/first_seen_date={day}")
    return sorted(str(d) for d in days)


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """The days of the postings table, newest first, from the folder listing."""
    prefix = "first_seen_date="
    return sorted((n.removeprefix(prefix) for n in _folders(spark, path) if n.startswith(prefix) and not n.startswith(prefix + "__")), reverse=True)


def newest_postings(spark: SparkSession, path: str, limit: int, columns: list[str] | None = None) -> DataFrame:
    """L1 over years of postings: the ``limit`` newest rows, reading days from the newest on until they hold enough.

    Each step doubles the number of days looked at and counts their rows (from the files' footers); the rows of all
    older days are never opened. Rows without a day count as oldest and are read only if all days are.
    """
    stored = spark.read.parquet(path)
    days, n = stored_days(spark, path), 1
    while n < len(days) and stored.where(F.col("first_seen_date") >= F.lit(days[n - 1]).cast("date")).count() < limit:
        n *= 2
    if n < len(days):
        stored = stored.where(F.col("first_seen_date") >= F.lit(days[n - 1]).cast("date"))
    rows = scan_postings(stored, columns)
    return rows.orderBy(F.col("first_seen_at").desc(), F.col("content_hash").asc()).limit(limit)


def write_sources(df: DataFrame, path: str, cycle_id: str, keep: int = 48) -> int:
    """Write the sources table after a cycle as a new version (S8); returns the version.

    The version is the newest stored one plus 1, whoever wrote that; a replayed cycle finds its own
    version by its ``cycle_id`` and rewrites it. Versions older than the newest ``keep`` are deleted.
    """
    spark = df.sparkSession
    stored = source_versions(spark, path)
    version = next((v for v, c in stored.items() if c == cycle_id), max(stored, default=0) + 1)
    (df.withColumns({"version": F.lit(version), "cycle_id": F.lit(cycle_id)}).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("version", "cycle_id").parquet(path))
    for old in sorted(stored)[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return version


def write_digest(df: DataFrame, path: str) -> None:
    """Append digest rows per cycle (S9); sending them is outside this library."""
    df.write.mode("append").partitionBy("cycle_id").parquet(path)

"""Queries for the stored history: keys in buckets, day sketches, stored-table removal, newest days.

Each derives a history from the given tables, stores it in a folder of its own below the shared folder, and runs the
operator on what it reads back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.operators.dedupe import content_key, insert_new
from jobtrail.operators.history import (KeyHistory, accepted, day_filters, only_unseen_clustered, only_unseen_sketched,
                                        write_day_filters)
from jobtrail.operators.search import text_search, trigram_index, with_source
from jobtrail.plans.oracle_views import with_views
from jobtrail.plans.q_extract import CAND_ORDER, CYCLE_ID, NOW
from jobtrail.plans.q_search import TEXT
from jobtrail.plans.registry import ORACLES, query
from jobtrail.sources.tables import STORED, newest_postings, remove_postings
from jobtrail.sources.workspace import new_folder

BUCKETS = 16
CAND_KEY = ["content_hash", "source_id", "l_orderkey", "l_linenumber", "l_partkey"]


def key_history(spark, rows, buckets: int = BUCKETS) -> KeyHistory:
    h = KeyHistory(spark, new_folder(spark, "key-history"), buckets)
    h.append(rows)
    return h


def _keyed(spark, d):
    return content_key(fixtures.candidates(spark, d), url_fallback=None)


def _known(spark, d):
    return fixtures.known_jobs(spark, d).withColumn("cycle_id", F.lit("cycle-0000"))


@query("only_unseen_bucketed", ORACLES["only_unseen"])
def q_only_unseen_bucketed(spark, d):
    return only_unseen_clustered(_keyed(spark, d), key_history(spark, _known(spark, d))).select(*CAND_KEY)


@query("insert_new_bucketed", ORACLES["insert_new"])
def q_insert_new_bucketed(spark, d):
    c = fixtures.candidates(spark, d).withColumn("tracked_url_id", F.col("source_id")).withColumn("raw", F.lit(""))
    n = insert_new(c, key_history(spark, _known(spark, d)), CAND_ORDER, CYCLE_ID, NOW, raw_text_col="raw", url_fallback=None)
    return n.select("content_hash", "tracked_url_id", "job_title", "company_name", "salary", F.array_join("tech_stack", ",").alias("tech"),
                    "requirements_summary", "job_url", "first_seen_at", "cycle_id")


# two overlapping cycles that both append the keys they found new
@query("overlapping_cycles", with_views("v_keyed") + """
select content_hash, case when min(l_orderkey % 2) = 0 then 'cycle-a' else 'cycle-b' end as cycle_id
from v_keyed where l_orderkey % 2 = 0 or l_orderkey % 3 = 0 group by content_hash""")
def q_overlapping_cycles(spark, d):
    k = _keyed(spark, d)
    found = {"cycle-a": k.where(F.col("l_orderkey") % 2 == 0), "cycle-b": k.where(F.col("l_orderkey") % 3 == 0)}
    rows = [f.select("content_hash").distinct().select("content_hash", F.lit(NOW).cast("timestamp_ntz").alias("first_seen_at"), F.lit(c).alias("cycle_id"))
            for c, f in found.items()]
    h = key_history(spark, rows[0])
    h.append(rows[1])
    return accepted(rows[0].unionByName(rows[1]), h).select("content_hash", "cycle_id")


@query("only_unseen_sketched", ORACLES["only_unseen"])
def q_only_unseen_sketched(spark, d):
    path, sketch = new_folder(spark, "stored"), new_folder(spark, "day-filters")
    rows = fixtures.known_jobs(spark, d).select("content_hash", F.trunc("first_seen_at", "month").alias("first_seen_date"))
    rows.repartition("first_seen_date").write.partitionBy("first_seen_date").parquet(path)
    stored = spark.read.parquet(path)
    write_day_filters(day_filters(stored), sketch)
    return only_unseen_sketched(_keyed(spark, d), stored, spark.read.parquet(sketch)).select(*CAND_KEY)


# ------------------------------------------------------------------ the stored postings table
def stored_jobs(spark, d) -> str:
    """The history as a stored table of one folder a day; its cycles ran on the first of each month."""
    path = new_folder(spark, "postings")
    month = F.date_trunc("month", F.col("added_at")).cast("timestamp_ntz")
    # dealt to their days before the postings are made: the narrower rows move
    firsts = fixtures.first_offers(fixtures.offers(spark, d)).withColumn("added_at", month).withColumn("first_seen_date", F.to_date("added_at"))
    (fixtures.as_postings(firsts.repartition("first_seen_date"), "first_seen_date")
             .write.option("compression", STORED).partitionBy("first_seen_date").parquet(path))
    return path


@query("removed_stored", with_views("v_jobs") + """
select content_hash, tracked_url_id, cast(date_trunc('month', first_seen_at) as varchar)[1:10] as day
from v_jobs where cast(tracked_url_id as bigint) % 10 <> 3""")
def q_removed_stored(spark, d):
    path = stored_jobs(spark, d)
    gone = fixtures.supplier_sources(spark, d).where(F.col("id").cast("long") % 10 == 3)
    remove_postings(spark, path, gone)
    return spark.read.parquet(path).select("content_hash", "tracked_url_id", F.col("first_seen_date").cast("string").alias("day"))


@query("newest_stored", with_views("v_jobs") + """
select content_hash, first_seen_at from (select content_hash, date_trunc('month', first_seen_at) as first_seen_at from v_jobs) j
order by first_seen_at desc, content_hash limit 2000""")
def q_newest_stored(spark, d):
    return newest_postings(spark, stored_jobs(spark, d), 2000, ["content_hash", "first_seen_at"]).select("content_hash", "first_seen_at")


# ------------------------------------------------------------------ P10 through a trigram index
@query("search_text_indexed", ORACLES["search_text"])
def q_search_text_indexed(spark, d):
    path, index = stored_jobs(spark, d), new_folder(spark, "trigrams")
    jobs, sources = spark.read.parquet(path), fixtures.supplier_sources(spark, d)
    trigram_index(with_source(jobs, sources)).write.option("compression", STORED).parquet(index)
    return text_search(jobs, sources, spark.read.parquet(index), TEXT).select("content_hash")

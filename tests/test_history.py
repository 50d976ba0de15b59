"""Stored keys in buckets and behind day sketches: plans, days read, overlapping cycles, replays, stored-table removal."""

import os
import re
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from jobtrail.operators.dedupe import insert_new, keep_first
from jobtrail.operators.history import (KeyHistory, accepted, day_filters, only_unseen_clustered, only_unseen_sketched, possible_days,
                                        write_day_filters)
from jobtrail.sources.tables import newest_postings, remove_postings, stored_days, write_postings

T0 = datetime(2025, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, keys, at=T0, cycle="c0"):
    return spark.createDataFrame([(k, at, cycle) for k in keys], "content_hash string, first_seen_at timestamp_ntz, cycle_id string")


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_scan(text):
    """The operators between the scan of the bucketed table and the join that reads it."""
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    depth = len(re.match(r"[ :|]*", lines[at])[0])
    out = []
    for x in reversed(lines[:at]):
        d = len(re.match(r"[ :|]*", x)[0])
        if d < depth:
            out.append(x.strip(" :+-*()0123456789"))
            depth = d
        if "Join" in x:
            break
    return out


@pytest.mark.parametrize("unique,buckets", [(True, 8), (False, 16)])
def test_no_exchange_above_the_history(spark, scratch, no_broadcast, unique, buckets):
    h = KeyHistory(spark, f"{scratch}/keys", buckets)
    h.append(rows(spark, [f"k{i}" for i in range(100)]))
    h.append(rows(spark, [f"k{i}" for i in range(90, 150)], cycle="c1"))
    cand = spark.createDataFrame([(f"k{i % 200}", i) for i in range(0, 400, 3)] + [(None, 7)], "content_hash string, n int")
    out = only_unseen_clustered(keep_first(cand, ["n"]) if unique else cand, h, unique)
    text = plan(out)
    assert "Bucketed: true" in text and not any("Exchange" in x for x in above_scan(text)), text
    got = sorted((str(r.content_hash), r.n) for r in out.collect())
    want = [(f"k{i % 200}", i) for i in range(0, 400, 3) if i % 200 >= 150] + [("None", 7)]
    if unique:
        want = [(k, n) for k, n in want if n == min(m for j, m in want if j == k)]
    assert got == sorted(want)


def test_any_session_derives_the_layout(spark, scratch):
    KeyHistory(spark, f"{scratch}/keys", 4).append(rows(spark, ["a", "b"]))
    other = KeyHistory(spark.newSession(), f"{scratch}/keys", 4)
    other.append(rows(other.spark, ["c"]))
    assert sorted(r.content_hash for r in KeyHistory(spark.newSession(), f"{scratch}/keys", 4).rows().collect()) == ["a", "b", "c"]
    assert other.holds("c0") and not other.holds("c9") and not replace(other, besides="c0").holds("c0")
    assert replace(other, besides="c0").rows().count() == 0


def test_overlapping_cycles_hold_each_key_once(spark, scratch, no_broadcast):
    h = KeyHistory(spark, f"{scratch}/keys", 9)
    a, b = rows(spark, ["x", "y"], T0, "b-cycle"), rows(spark, ["y", "z", "x"], T0, "a-cycle")
    h.append(a)
    h.append(b)
    h.append(rows(spark, ["x"], datetime(2024, 1, 1), "late-writer"))
    got = sorted((r.content_hash, r.cycle_id) for r in h.winners().collect())
    assert got == [("x", "late-writer"), ("y", "a-cycle"), ("z", "a-cycle")]
    text = plan(h.winners())
    assert "Exchange" not in text, text
    assert sorted((r.content_hash, r.cycle_id) for r in accepted(a.unionByName(b), h).collect()) == [("y", "a-cycle"), ("z", "a-cycle")]


def test_insert_new_probes_the_buckets(spark, scratch):
    h = KeyHistory(spark, f"{scratch}/keys", 3)
    c = spark.createDataFrame([("1", i, f"T{i % 4}", "C", "https://u", None, ["A"] * 30, "s" * 2000) for i in range(12)],
                              "tracked_url_id string, pos int, job_title string, company_name string, job_url string, salary string, tech_stack array<string>, requirements_summary string")
    first = insert_new(c, h, ["pos"], "c1", T0, raw_text_col=None, url_fallback=None)
    assert sorted(r.pos for r in first.collect()) == [0, 1, 2, 3]
    h.append(first)
    assert insert_new(c, h, ["pos"], "c2", T0, raw_text_col=None, url_fallback=None).count() == 0
    # a replay of the same cycle finds the same rows again
    assert insert_new(c, replace(h, besides="c1"), ["pos"], "c1", T0, raw_text_col=None, url_fallback=None).count() == 4


# ------------------------------------------------------------------ day sketches
def stored_by_day(spark, path, days=40, a_day=300):
    r = spark.range(days * a_day).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"),
                                         F.expr(f"date_add(date'2024-01-01', int(id div {a_day}))").alias("first_seen_date"))
    r.repartition("first_seen_date").write.partitionBy("first_seen_date").parquet(path)
    return spark.read.parquet(path)


def test_only_days_that_may_hold_a_candidate_are_read(spark, scratch):
    stored = stored_by_day(spark, f"{scratch}/stored")
    write_day_filters(day_filters(stored, 1 << 12), f"{scratch}/filters")
    filters = spark.read.parquet(f"{scratch}/filters")
    known = [5 * 300 + 7, 5 * 300 + 8, 31 * 300]
    cand = spark.createDataFrame([(i,) for i in known + list(range(50_000, 50_005))], "id long").select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), "id")
    days = {r[0] for r in possible_days(cand, filters, 1 << 12).select("first_seen_date").distinct().collect()}
    assert {date(2024, 1, 6), date(2024, 2, 1)} <= days and len(days) <= 6
    out = only_unseen_sketched(cand.unionByName(cand.limit(1).select(F.lit(None).cast("string").alias("content_hash"), F.lit(9).cast("long").alias("id"))), stored, filters, 1 << 12)
    assert sorted(r.id for r in out.collect()) == [9, *range(50_000, 50_005)]
    read = set(re.findall(r"\d{4}-\d\d-\d\d", re.search(r"PartitionFilters: \[([^\]]*)\]", plan(out))[1]))
    assert read == {str(x) for x in days}
    new = spark.createDataFrame([("no such key",)], "content_hash string")
    assert only_unseen_sketched(new, stored, filters.limit(0), 1 << 12).count() == 1


def test_no_filter_misses_a_key_and_few_hit_by_chance(spark, scratch):
    stored = stored_by_day(spark, f"{scratch}/stored", days=4, a_day=4000)
    parts = [day_filters(stored.where(F.col("content_hash") < "8"), 1 << 10), day_filters(stored.where(F.col("content_hash") >= "8"), 1 << 10)]
    for p in parts:  # two parts of every day's filter
        write_day_filters(p, f"{scratch}/filters")
    filters = spark.read.parquet(f"{scratch}/filters")
    hit = possible_days(stored, filters, 1 << 10)
    assert stored.join(hit, ["content_hash", "first_seen_date"], "left_anti").count() == 0
    none = spark.range(10_000).select(F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256).alias("content_hash"))
    assert possible_days(none, filters, 1 << 10).count() < 0.1 * 4 * 10_000


# ------------------------------------------------------------------ the stored postings table
def stored_postings(spark, path):
    r = spark.range(600).select(F.col("id").cast("string").alias("content_hash"), (F.col("id") % 7).cast("string").alias("tracked_url_id"),
                                F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id div 30), 0, 0, 0)").alias("first_seen_at"), F.lit("t").alias("job_title"))
    write_postings(r.where("tracked_url_id <> '6' or id < 60"), path)


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_removal_touches_the_days_concerned_only(spark, scratch):
    path = f"{scratch}/postings"
    stored_postings(spark, path)
    spark.createDataFrame([("only", "6", datetime(2023, 5, 5), "t")], "content_hash string, tracked_url_id string, first_seen_at timestamp_ntz, job_title string").createOrReplaceTempView("one")
    write_postings(spark.table("one"), path)
    before, n = listing(path), spark.read.parquet(path).count()
    gone = spark.createDataFrame([("6",), ("none",)], "id string")
    lost = spark.read.parquet(path).where("tracked_url_id = '6'").count()
    assert remove_postings(spark, path, gone) == ["2023-05-05", "2024-01-01", "2024-01-02"]
    left = spark.read.parquet(path)
    assert left.count() == n - lost and left.where("tracked_url_id = '6'").count() == 0
    after = listing(path)
    keep = {f: t for f, t in before.items() if not re.search("date=(2023-05-05|2024-01-01|2024-01-02)", f)}
    assert keep.items() <= after.items() and not any("2023-05-05" in f for f in after)
    assert remove_postings(spark, path, gone) == []


def test_newest_reads_the_newest_days(spark, scratch):
    path = f"{scratch}/postings"
    stored_postings(spark, path)
    assert len(stored_days(spark, path)) == 20 and stored_days(spark, path)[0] == "2024-01-20"
    for limit, most in ((10, 1), (40, 2), (100, 4), (100_000, 20)):
        out = newest_postings(spark, path, limit, ["content_hash", "first_seen_at"])
        every = spark.read.parquet(path).orderBy(F.col("first_seen_at").desc(), "content_hash").limit(limit)
        assert [r.content_hash for r in out.collect()] == [r.content_hash for r in every.collect()]
        bounds = re.findall(r"first_seen_date#\d+ >= (\d{4}-\d\d-\d\d)", plan(out))
        assert sum(not bounds or x >= bounds[0] for x in stored_days(spark, path)) <= most


def test_remaining_postings_are_written_once(spark, scratch, monkeypatch):
    from jobtrail.sources import tables, workspace

    rows = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), (F.col("id") % 4).cast("string").alias("tracked_url_id"),
                                  F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(id % 3))").alias("first_seen_at"))
    write_postings(rows, scratch + "/p")
    before = sorted(r[0] for r in spark.read.parquet(scratch + "/p").where("tracked_url_id <> '1'").select("content_hash").collect())

    def none(*a):
        raise AssertionError("an intermediate copy")

    monkeypatch.setattr(workspace, "kept", none)
    monkeypatch.setattr(tables, "kept", none, raising=False)
    assert len(remove_postings(spark, scratch + "/p", spark.createDataFrame([("1",)], "id string"))) == 3
    assert sorted(r[0] for r in spark.read.parquet(scratch + "/p").select("content_hash").collect()) == before

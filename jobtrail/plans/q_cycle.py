"""Queries for the scrape cycle and its digest: P7, J3, C1-C5, G1-G3."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.operators import digest as dg
from jobtrail.operators.cycle import (ROBOTS_REASON, STATIC_STATUS, UNKNOWN_ERROR, apply_status, cycle_failures,
                                      cycle_pages, cycle_summary, latest_status, run_cycle, source_outcomes)
from jobtrail.plans.oracle_views import add_view, collapse, trim_js, with_views
from jobtrail.plans.registry import query

# Fixed parameters of the registered queries.
CYCLE_ID = "cycle-0001"
TRIGGER = "cron"
STARTED = datetime(2025, 1, 1, 12, 0, 0)
NOW = datetime(2025, 1, 1, 12, 0, 30)
FINISHED = datetime(2025, 1, 1, 12, 1, 0)


def _ts(d):
    return f"timestamp '{d:%Y-%m-%d %H:%M:%S}'"


def _cycle(spark, d):
    return run_cycle(fixtures.tracked(spark, d), fixtures.landed_snapshots(spark, d), fixtures.robots(spark, d),
                     fixtures.landed_replies(spark, d), fixtures.known_jobs(spark, d), CYCLE_ID, NOW)


def _outcomes(spark, d):
    return source_outcomes(fixtures.tracked(spark, d), fixtures.landed_snapshots(spark, d), fixtures.robots(spark, d))


@query("cycle_pages", with_views("v_tracked", "v_landed") + """
select t.id, s.tracked_url_id is not null as has_snapshot, s.final_url, s.http_status, s.error
from v_tracked t left join v_landed s on s.tracked_url_id = t.id""")
def q_cycle_pages(spark, d):
    return cycle_pages(fixtures.tracked(spark, d), fixtures.landed_snapshots(spark, d)).select(
        "id", "has_snapshot", "final_url", "http_status", "error")


add_view("o_status", f"""
select *, case when reason is null then 'success' else 'failed' end as status from (
  select t.id, t.url, t.label, t.source_type, t.added_at, t.route, t.has_snapshot, t.http_status,
         case when not robots_allowed then '{ROBOTS_REASON.replace("'", "''")}'
              when not has_snapshot then '{UNKNOWN_ERROR}'
              when error is not null then error
              when route = 'static' and not coalesce(http_status between 200 and 299, false)
                then '{STATIC_STATUS}' || coalesce(cast(http_status as varchar), 'unknown') end as reason
  from (select t.*, case when t.source_type = 'linkedin' or regexp_matches(t.url, '(?i)linkedin\\.com') then 'browser' else 'static' end as route,
               g.disallow_len = -1 or g.allow_len >= g.disallow_len as robots_allowed,
               s.tracked_url_id is not null as has_snapshot, s.http_status, s.error
        from v_tracked t join o_gate g on g.id = t.id left join v_landed s on s.tracked_url_id = t.id) t) x""",
         ("v_tracked", "o_gate", "v_landed"))


@query("fetch_outcomes", with_views("o_status") + "select id, route, has_snapshot, http_status, status, reason from o_status")
def q_fetch_outcomes(spark, d):
    o = _outcomes(spark, d)
    meta = fixtures.landed_snapshots(spark, d).select(F.col("tracked_url_id").alias("id"), "http_status")
    return o.join(meta, "id", "left").select("id", "route", F.col("final_url").isNotNull().alias("has_snapshot"),
                                             "http_status", "status", "reason")


@query("source_outcomes", with_views("o_status") + "select id, url, added_at, status, reason from o_status")
def q_source_outcomes(spark, d):
    return _outcomes(spark, d).select("id", "url", "added_at", "status", "reason")


@query("cycle_failures", with_views("o_status") + "select id, url, reason from o_status where status = 'failed'")
def q_cycle_failures(spark, d):
    return cycle_failures(_outcomes(spark, d)).select("id", "url", "reason")


@query("apply_status", with_views("o_status") + f"""
select id, status as last_scrape_status, {_ts(NOW)} as last_scraped_at from o_status""")
def q_apply_status(spark, d):
    return apply_status(fixtures.tracked(spark, d), _outcomes(spark, d), NOW).select(
        "id", "last_scrape_status", "last_scraped_at")


@query("latest_status", with_views("v_attempts") + """
select source_id, status as last_scrape_status, ts as last_scraped_at from (
  select *, row_number() over (partition by source_id order by ts desc, event_id desc) as rn from v_attempts) a where rn = 1""")
def q_latest_status(spark, d):
    return latest_status(fixtures.attempts(spark, d))


add_view("o_cycle_new", f"""
select content_hash, tracked_url_id, pos, added_at, {trim_js('job_title')} as job_title, {trim_js('company_name')} as company_name,
       nullif({trim_js('salary')}, '') as salary, tech, substring({collapse('requirements_summary')}, 1, 1200) as requirements_summary,
       job_url, substring(page_text, 1, 14000) as raw_text, {_ts(NOW)} as first_seen_at, '{CYCLE_ID}' as cycle_id
from (select p.*, row_number() over (partition by content_hash order by added_at, tracked_url_id, pos) as rn
      from (select p.*, sha256(lower(job_title) || '|' || lower(company_name) || '|' || lower(job_url)) as content_hash
            from o_postings p where p.tracked_url_id in (select id from o_status where status = 'success')) p) x
where rn = 1 and content_hash not in (select content_hash from v_known_jobs)""", ("o_postings", "o_status", "v_known_jobs"))


@query("run_cycle", with_views("o_cycle_new") + """
select content_hash, tracked_url_id, pos, job_title, company_name, salary, tech, requirements_summary, job_url,
       md5(raw_text) as raw_text_md5, first_seen_at, cycle_id from o_cycle_new""")
def q_run_cycle(spark, d):
    n = _cycle(spark, d).new_rows
    return n.select("content_hash", "tracked_url_id", F.col("pos").cast("long").alias("pos"), "job_title", "company_name",
                    "salary", F.array_join("tech_stack", ",").alias("tech"), "requirements_summary", "job_url",
                    F.md5("raw_text").alias("raw_text_md5"), "first_seen_at", "cycle_id")


@query("cycle_summary", with_views("o_status", "o_cycle_new") + f"""
select {_ts(STARTED)} as started_at, {_ts(FINISHED)} as finished_at,
       (select count(*) from o_status) as scanned_count, (select count(*) from o_cycle_new) as new_jobs_count,
       (select count(*) from o_status where status = 'failed') as failed_count,
       (select count(*) from o_cycle_new) > 0 as digest_sent""")
def q_cycle_summary(spark, d):
    c = _cycle(spark, d)
    return cycle_summary(c.outcomes, c.new_rows, STARTED, FINISHED)


def _digest_rows(spark, d):
    return dg.digest_rows(_cycle(spark, d).new_rows, fixtures.tracked(spark, d))


add_view("o_digest", """
select n.cycle_id, n.added_at, n.tracked_url_id, n.pos, n.job_title as jobTitle, n.company_name as companyName, n.salary,
       n.tech as techStack, n.requirements_summary as requirementsSummary, n.job_url as jobUrl, t.url as sourceUrl,
       n.first_seen_at as firstSeenAt
from o_cycle_new n left join v_tracked t on t.id = n.tracked_url_id""", ("o_cycle_new", "v_tracked"))


@query("digest_rows", with_views("o_digest") + """
select cycle_id, tracked_url_id, pos, jobTitle, companyName, salary, techStack, requirementsSummary, jobUrl, sourceUrl, firstSeenAt
from o_digest""")
def q_digest_rows(spark, d):
    r = _digest_rows(spark, d)
    return r.select("cycle_id", "tracked_url_id", F.col("pos").cast("long").alias("pos"), "jobTitle", "companyName", "salary",
                    F.array_join("techStack", ",").alias("techStack"), "requirementsSummary", "jobUrl", "sourceUrl",
                    "firstSeenAt")


@query("digest_header", with_views("o_digest") + f"""
select cycle_id, '{TRIGGER}' as trigger, count(*) as new_jobs,
       'Job digest: ' || cast(count(*) as varchar) || ' new role' || case when count(*) > 1 then 's' else '' end as subject
from o_digest group by cycle_id""")
def q_digest_header(spark, d):
    return dg.digest_header(_digest_rows(spark, d), TRIGGER)


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("digest_html", with_views("o_digest") + f"""
select cycle_id, cast(0 as bigint) as part, null as tracked_url_id, null as pos,
       {_lit(dg.HEAD_1)} || {_esc(_lit(dg.DEFAULT_TITLE))} || {_lit(dg.HEAD_2)} || '{TRIGGER}' || {_lit(dg.HEAD_3)}
       || cast(count(*) as varchar) || {_lit(dg.HEAD_4)} as html
from o_digest group by cycle_id
union all
select cycle_id, cast(1 as bigint) as part, tracked_url_id, pos,
       {_lit(dg.ROW_OPEN)} || {_esc('companyName')} || {_lit(dg.ROW_CELL)} || {_esc('jobTitle')} || {_lit(dg.ROW_CELL)}
       || {_esc("coalesce(nullif(salary, ''), 'Not specified')")} || {_lit(dg.ROW_CELL)}
       || {_esc("case when techStack = '' then 'Not specified' else replace(techStack, ',', ', ') end")} || {_lit(dg.ROW_CELL)}
       || {_esc('substring(requirementsSummary, 1, 260)')} || {_lit(dg.ROW_CELL)} || {_lit(dg.ROW_LINK_OPEN)}
       || {_esc('jobUrl')} || {_lit(dg.ROW_CLOSE)} as html
from o_digest
union all
select cycle_id, cast(2 as bigint) as part, null as tracked_url_id, null as pos, {_lit(dg.FOOT)} as html from o_digest group by cycle_id""")
def q_digest_html(spark, d):
    h = dg.digest_html(_digest_rows(spark, d), TRIGGER)
    return h.select("cycle_id", F.col("part").cast("long").alias("part"), "tracked_url_id",
                    F.col("pos").cast("long").alias("pos"), "html")


# ------------------------------------------------------------------ a backlog: two visits and two replies per source
@query("outcomes_backlog", with_views("o_status") + "select id, status, reason, cast(1 as bigint) as n from o_status")
def q_outcomes_backlog(spark, d):
    o = source_outcomes(fixtures.tracked(spark, d), fixtures.backlog_snapshots(spark, d), fixtures.robots(spark, d))
    return o.groupBy("id").agg(F.max("status").alias("status"), F.max("reason").alias("reason"), F.count("*").alias("n"))


@query("run_cycle_backlog", with_views("o_cycle_new") + "select content_hash, tracked_url_id, pos, job_title from o_cycle_new")
def q_run_cycle_backlog(spark, d):
    c = run_cycle(fixtures.tracked(spark, d), fixtures.backlog_snapshots(spark, d), fixtures.robots(spark, d),
                  fixtures.backlog_replies(spark, d), fixtures.known_jobs(spark, d), CYCLE_ID, NOW)
    return c.new_rows.select("content_hash", "tracked_url_id", F.col("pos").cast("long").alias("pos"), "job_title")


# ------------------------------------------------------------------ a second cycle against the postings of the first
add_view("o_keyed_pages", """
select p.*, sha256(lower(job_title) || '|' || lower(company_name) || '|' || lower(job_url)) as content_hash
from o_postings p where p.tracked_url_id in (select id from o_status where status = 'success')""", ("o_postings", "o_status"))


@query("second_cycle", with_views("o_keyed_pages") + """
select content_hash, tracked_url_id, pos, job_title from (
  select *, row_number() over (partition by content_hash order by added_at, tracked_url_id, pos) as rn from o_keyed_pages) x
where rn = 1 and content_hash not in (select content_hash from o_keyed_pages where page_id % 2 = 0)""")
def q_second_cycle(spark, d):
    sources, robots, replies = fixtures.tracked(spark, d), fixtures.robots(spark, d), fixtures.landed_replies(spark, d)
    snaps = fixtures.landed_snapshots(spark, d)
    none = spark.createDataFrame([], "content_hash string")
    first = run_cycle(sources, snaps.where(F.col("page_id") % 2 == 0), robots, replies, none, "cycle-0000", STARTED)
    second = run_cycle(sources, snaps, robots, replies, first.new_rows.select("content_hash"), CYCLE_ID, NOW)
    return second.new_rows.select("content_hash", "tracked_url_id", F.col("pos").cast("long").alias("pos"), "job_title")

"""Queries for search over stored postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.operators.search import (date_range, display_view, newest, normalize_result, search, tech_filter, text_filter,
                                       with_source)
from jobtrail.plans.oracle_views import with_views
from jobtrail.plans.registry import query

# Fixed parameters of the registered queries.
START, END = "1994-01-01", "1996-12-31"
TECH = "node"
TEXT = "label supplier#00000001"
LIMIT = "1000"


# The days of START and END as bounds, written out.
FROM, TO = "timestamp '1994-01-01 00:00:00'", "timestamp '1996-12-31 23:59:59.999'"


def _src(spark, d):
    return with_source(fixtures.jobs(spark, d), fixtures.supplier_sources(spark, d))


@query("search_dates", with_views("v_jobs") +
       f"select content_hash, first_seen_at from v_jobs where first_seen_at >= {FROM} "
       f"and first_seen_at <= {TO}")
def q_search_dates(spark, d):
    return date_range(fixtures.jobs(spark, d), START, END).select("content_hash", "first_seen_at")


@query("search_short_dates", with_views("v_jobs") + """
select content_hash from v_jobs where first_seen_at >= timestamp '1995-02-01 00:00:00' and first_seen_at <= timestamp '1996-01-01 23:59:59.999'""")
def q_search_short_dates(spark, d):
    return date_range(fixtures.jobs(spark, d), "1995-02", "1996").select("content_hash")


@query("search_tech", with_views("v_jobs") +
       f"select content_hash from v_jobs where len(list_filter(tech_stack, lambda e: contains(lower(e), '{TECH}'))) > 0")
def q_search_tech(spark, d):
    return tech_filter(fixtures.jobs(spark, d), TECH).select("content_hash")


@query("search_text", with_views("v_jobs", "v_supplier_sources") + f"""
select j.content_hash from v_jobs j left join v_supplier_sources s on s.id = j.tracked_url_id
where contains(lower(concat_ws(' ', coalesce(j.company_name, ''), coalesce(j.job_title, ''), coalesce(s.url, ''), coalesce(s.label, ''))), '{TEXT}')""")
def q_search_text(spark, d):
    return text_filter(_src(spark, d), TEXT).select("content_hash")


@query("postings_with_source", with_views("v_jobs", "v_supplier_sources") + """
select j.content_hash, j.tracked_url_id, s.url as source_url, s.label as source_label, s.source_type
from v_jobs j left join v_supplier_sources s on s.id = j.tracked_url_id""")
def q_postings_with_source(spark, d):
    return _src(spark, d).select("content_hash", "tracked_url_id", F.col("tracked_urls.url").alias("source_url"),
                                 F.col("tracked_urls.label").alias("source_label"),
                                 F.col("tracked_urls.source_type").alias("source_type"))


@query("normalize_results", with_views("v_jobs", "v_supplier_sources") + """
select coalesce(j.content_hash, '') as content_hash, coalesce(j.tracked_url_id, '') as tracked_url_id,
       coalesce(j.job_title, '') as job_title, coalesce(j.company_name, '') as company_name,
       nullif(j.salary, '') as salary,
       array_to_string(list_filter(list_transform(coalesce(j.tech_stack, []), lambda e: coalesce(e, 'null')), lambda e: e <> ''), ',') as tech,
       coalesce(j.requirements_summary, '') as requirements_summary, coalesce(j.job_url, '') as job_url, s.url as source_url
from v_jobs j left join v_supplier_sources s on s.id = j.tracked_url_id""")
def q_normalize_results(spark, d):
    n = normalize_result(_src(spark, d))
    return n.select("content_hash", "tracked_url_id", "job_title", "company_name", "salary",
                    F.array_join("tech_stack", ",").alias("tech"), "requirements_summary", "job_url",
                    F.col("tracked_urls.url").alias("source_url"))


@query("display_view", with_views("v_jobs", "v_supplier_sources") + """
select j.content_hash, coalesce(nullif(s.label, ''), nullif(s.url, ''), 'Unknown source') as source_display,
       coalesce(nullif(j.salary, ''), 'Salary not specified') as salary_display,
       case when len(j.tech_stack) > 0 then array_to_string(j.tech_stack, ',') else 'Not specified' end as tech_display
from v_jobs j left join v_supplier_sources s on s.id = j.tracked_url_id""")
def q_display_view(spark, d):
    v = display_view(_src(spark, d))
    return v.select("content_hash", "source_display", "salary_display", F.array_join("tech_display", ",").alias("tech_display"))


@query("newest", with_views("v_jobs") +
       f"select content_hash, first_seen_at from v_jobs order by first_seen_at desc, content_hash limit {LIMIT}")
def q_newest(spark, d):
    return newest(fixtures.jobs(spark, d), int(LIMIT)).select("content_hash", "first_seen_at")


@query("search", with_views("v_jobs", "v_supplier_sources") + f"""
select t.content_hash, t.first_seen_at, t.job_title, t.company_name, s.url as source_url
from (select * from v_jobs where first_seen_at >= {FROM} and first_seen_at <= {TO}
      order by first_seen_at desc, content_hash limit {LIMIT}) t
left join v_supplier_sources s on s.id = t.tracked_url_id
where len(list_filter(t.tech_stack, lambda e: contains(lower(e), '{TECH}'))) > 0
  and contains(lower(concat_ws(' ', coalesce(t.company_name, ''), coalesce(t.job_title, ''), coalesce(s.url, ''), coalesce(s.label, ''))), 'label')""")
def q_search(spark, d):
    r = search(fixtures.jobs(spark, d), fixtures.supplier_sources(spark, d), tech=TECH, company_or_source="label",
               start_date=START, end_date=END, limit=LIMIT)
    return r.select("content_hash", "first_seen_at", "job_title", "company_name", F.col("tracked_urls.url").alias("source_url"))


@query("search_all_filters", with_views("v_jobs", "v_supplier_sources") + f"""
select j.content_hash, j.first_seen_at, s.url as source_url
from v_jobs j left join v_supplier_sources s on s.id = j.tracked_url_id
where first_seen_at >= {FROM} and first_seen_at <= {TO}
  and len(list_filter(j.tech_stack, lambda e: contains(lower(e), '{TECH}'))) > 0
  and contains(lower(concat_ws(' ', coalesce(j.company_name, ''), coalesce(j.job_title, ''), coalesce(s.url, ''), coalesce(s.label, ''))), '{TEXT}')
order by first_seen_at desc, content_hash limit 20""")
def q_search_all_filters(spark, d):
    r = search(fixtures.jobs(spark, d), fixtures.supplier_sources(spark, d), tech=TECH, company_or_source=TEXT,
               start_date=START, end_date=END, limit="20", filter_first=True)
    return r.select("content_hash", "first_seen_at", F.col("tracked_urls.url").alias("source_url"))

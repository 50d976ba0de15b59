"""Queries for sources: S1, S2, P1-P6, U1-U3, R1, R2/J4."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.functions.urls import with_canonical_url
from jobtrail.operators.cycle import latest_status, route_sources
from jobtrail.operators.registry import cascade_postings, register_sources, remove_sources, validate_submissions
from jobtrail.operators.robots import robots_gate, robots_gate_indexed, robots_rules
from jobtrail.plans.oracle_views import add_view, trim_js, with_views
from jobtrail.plans.registry import ORACLES, query
from jobtrail.sources.tables import cycle_sources, list_sources, read_table

NOW = datetime(2025, 1, 1, 12, 0, 0)


@query("list_sources", with_views("v_tracked") +
       "select id, url, label, source_type, added_at, last_scraped_at, last_scrape_status from v_tracked")
def q_list_sources(spark, d):
    return list_sources(fixtures.tracked(spark, d))


@query("cycle_sources", with_views("v_tracked") + "select id, url, source_type, added_at from v_tracked")
def q_cycle_sources(spark, d):
    return cycle_sources(fixtures.tracked(spark, d)).select("id", "url", "source_type", "added_at")


@query("route_sources", with_views("v_tracked") + """
select id, case when source_type = 'linkedin' or regexp_matches(url, '(?i)linkedin\\.com') then 'browser' else 'static' end as route
from v_tracked""")
def q_route_sources(spark, d):
    return route_sources(fixtures.tracked(spark, d)).select("id", "route")


# canonical URL oracle: regex steps written for DuckDB
add_view("o_canon", f"""
select submit_no, u, scheme, rest,
  case when u = '' then null
       when scheme = '' then null
       when scheme in ('http', 'https', 'ws', 'wss', 'ftp') then
         case when host = '' or regexp_matches(host, '[ #%/:<>?@\\[\\\\\\]^|]') or not regexp_matches(port, '^[0-9]*$') then null
              else scheme || '://' || host
                   || case when port = '' or (scheme in ('http', 'ws') and cast(port as int) = 80) or (scheme in ('https', 'wss') and cast(port as int) = 443)
                                or (scheme = 'ftp' and cast(port as int) = 21) then '' else ':' || cast(cast(port as int) as varchar) end
                   || case when path = '' then '/' else
                        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path,
                          '/\\.(/|$)', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/'), '^/\\.\\.(/|$)', '/') end
                   || replace(query, ' ', '%20') || replace(frag, ' ', '%20') end
       else scheme || ':' || rest end as canonical_url
from (select submit_no, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) as scheme,
             regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:(.*)$', 1) as rest,
             lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1)) as host,
             regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#:]*:([^/?#]*)', 1) as port,
             regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) as path,
             regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) as query,
             regexp_extract(u, '(#.*)$', 1) as frag
      from (select submit_no, coalesce({trim_js('url')}, '') as u from v_submissions) s) p""", ("v_submissions",))
add_view("o_valid_subs", """
select s.submit_no, c.canonical_url, nullif(""" + trim_js("s.label") + """, '') as label,
       coalesce(s.source_type, case when regexp_matches(c.canonical_url, '(?i)linkedin\\.com') then 'linkedin' else 'company_page' end) as source_type,
       case when c.u = '' then 'url is required' when c.canonical_url is null then 'url must be a valid absolute URL' end as reason
from v_submissions s join o_canon c on c.submit_no = s.submit_no""", ("v_submissions", "o_canon"))


@query("validate_submissions", with_views("o_valid_subs") +
       "select submit_no, reason, reason is null as accepted from o_valid_subs")
def q_validate_submissions(spark, d):
    v = validate_submissions(fixtures.submissions(spark, d))
    return v.select("submit_no", "reason", F.col("reason").isNull().alias("accepted"))


@query("canonical_urls", with_views("o_canon") + "select submit_no, canonical_url from o_canon")
def q_canonical_urls(spark, d):
    return validate_submissions(fixtures.submissions(spark, d)).select("submit_no", "canonical_url")


@query("source_types", with_views("o_valid_subs") + "select submit_no, source_type from o_valid_subs where reason is null")
def q_source_types(spark, d):
    v = validate_submissions(fixtures.submissions(spark, d))
    return v.where(F.col("reason").isNull()).select("submit_no", "source_type")


@query("register_sources", with_views("o_valid_subs", "v_tracked") + """
select v.submit_no, v.canonical_url as url, v.label, v.source_type,
       case when coalesce(v.reason, case when f.submit_no is null or t.url is not null then 'URL already exists' end) is null
            then 'created' else 'rejected' end as status,
       coalesce(v.reason, case when f.submit_no is null or t.url is not null then 'URL already exists' end) as reason
from o_valid_subs v
left join (select canonical_url, min(submit_no) as submit_no from o_valid_subs where reason is null group by canonical_url) f
  on f.canonical_url = v.canonical_url and f.submit_no = v.submit_no
left join (select distinct url from v_tracked) t on t.url = v.canonical_url""")
def q_register_sources(spark, d):
    _, outcomes = register_sources(fixtures.tracked(spark, d), fixtures.submissions(spark, d), NOW)
    return outcomes.select("submit_no", "url", "label", "source_type", "status", "reason")


@query("registered_table", with_views("o_valid_subs", "v_tracked") + f"""
select substring(sha256(canonical_url), 1, 32) as id, canonical_url as url, label, source_type, timestamp '{NOW:%Y-%m-%d %H:%M:%S}' as added_at, 'pending' as last_scrape_status
from (select *, row_number() over (partition by canonical_url order by submit_no) as rn from o_valid_subs where reason is null) v
where rn = 1 and canonical_url not in (select url from v_tracked)
union all select id, url, label, source_type, added_at, last_scrape_status from v_tracked""")
def q_registered_table(spark, d):
    table, _ = register_sources(fixtures.tracked(spark, d), fixtures.submissions(spark, d), NOW)
    return table.select("id", "url", "label", "source_type", "added_at", "last_scrape_status")


@query("canonical_urls_encoded", r"""
select page_id, 'https://www.ex.com/stra%C3%9Fe/' || page_id || '/b%20c?q=x\y%20%C3%A9#f\%C3%BC' as canonical_url from pages""")
def q_canonical_urls_encoded(spark, d):
    raw = F.concat(F.lit("HTTPS:\\\\www.EX.com:443/straße\\"), F.col("page_id").cast("string"), F.lit("\\b c?q=x\\y é#f\\ü"))
    return with_canonical_url(read_table(spark, d, "pages").select("page_id", raw.alias("url")), "url").select("page_id", "canonical_url")


# host names outside ASCII, as a browser writes them
@query("canonical_urls_hosts", """
select page_id, case page_id % 6 when 0 then 'https://www.xn--bcher-kva.example/' when 1 then 'http://u:p@xn--wgv71a119e.jp:8080/%C3%A4'
    when 2 then 'https://xn--strae-oqa.example/?q=%C3%A9' when 3 then 'https://xn--nxasmm1c.example/' when 4 then 'https://softhyphen.example/' else 'https://plain.example/%C3%BC' end as canonical_url from pages""")
def q_canonical_urls_hosts(spark, d):
    urls = ["HTTPS://www.B\u00dcCHER.example:443", "http://u:p@\u65e5\u672c\u8a9e\u3002\uff2a\uff30:8080/\u00e4", " https:\\\\stra\u00dfe.example?q=\u00e9",
            "https://\u03b2\u03cc\u03bb\u03bf\u03c2.example/", "https://soft\u00adhyphen.example", "https://plain.example/\u00fc"]
    raw = F.element_at(F.array(*[F.lit(u) for u in urls]), (F.col("page_id") % 6 + 1).cast("int"))
    return with_canonical_url(read_table(spark, d, "pages").select("page_id", raw.alias("url")), "url").select("page_id", "canonical_url")


# removal requests: sources whose last recorded attempt failed (ids padded, as typed by a user)
add_view("o_removed", """
select distinct source_id as id from (
  select source_id, status, row_number() over (partition by source_id order by ts desc, event_id desc) as rn from v_attempts) a
where rn = 1 and status = 'failed'""", ("v_attempts",))


def removal_requests(spark, d):
    failed = latest_status(fixtures.attempts(spark, d)).where(F.col("last_scrape_status") == "failed")
    return failed.select(F.concat(F.lit(" "), F.col("source_id"), F.lit(" ")).alias("id"))


@query("remove_sources", with_views("v_tracked", "o_removed") +
       "select id, url from v_tracked where id not in (select id from o_removed)")
def q_remove_sources(spark, d):
    remaining, _ = remove_sources(fixtures.tracked(spark, d), removal_requests(spark, d))
    return remaining.select("id", "url")


@query("remove_outcomes", with_views("o_removed") + "select id, 'removed' as status, cast(null as varchar) as reason from o_removed union all select '', 'rejected', 'id is required'")
def q_remove_outcomes(spark, d):
    blank = spark.createDataFrame([("  ",)], "id string")
    _, outcomes = remove_sources(fixtures.tracked(spark, d), removal_requests(spark, d).unionByName(blank))
    return outcomes


@query("cascade_postings", with_views("v_jobs", "o_removed") +
       "select content_hash, tracked_url_id from v_jobs where tracked_url_id not in (select id from o_removed)")
def q_cascade_postings(spark, d):
    ids = removal_requests(spark, d).select(F.trim("id").alias("id"))
    return cascade_postings(fixtures.jobs(spark, d), ids).select("content_hash", "tracked_url_id")


# robots rules and gate
add_view("o_rules", f"""
select origin, line_no, key as kind, value as prefix from (
  select origin, line_no, key, value,
         coalesce(last_value(case when key = 'user-agent' then value = '*' end ignore nulls)
                  over (partition by origin order by line_no rows between unbounded preceding and current row), false) as active
  from (select origin, line_no, lower({trim_js("split_part(line, ':', 1)")}) as key,
               {trim_js("substring(line, strpos(line, ':') + 1)")} as value
        from (select origin, line_no, {trim_js("split_part(raw, '#', 1)")} as line
              from (select origin, unnest(string_split_regex(body, '\\r?\\n')) as raw,
                           unnest(range(0, len(string_split_regex(body, '\\r?\\n')))) as line_no
                    from v_robots where http_status between 200 and 299 and body is not null) l) c
        where strpos(line, ':') > 1) k
  where key <> '') a
where active and kind in ('allow', 'disallow') and prefix <> ''""", ("v_robots",))
add_view("o_gate", """
select t.id, coalesce(max(case when r.kind = 'allow' then length(r.prefix) end), -1) as allow_len,
       coalesce(max(case when r.kind = 'disallow' then length(r.prefix) end), -1) as disallow_len
from (select id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)) as origin,
             coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), ''), '/') as path
      from v_tracked) t
left join o_rules r on r.origin = t.origin and starts_with(t.path, r.prefix)
group by t.id""", ("v_tracked", "o_rules"))


@query("robots_rules", with_views("o_rules") + "select origin, line_no, kind, prefix from o_rules")
def q_robots_rules(spark, d):
    return robots_rules(fixtures.robots(spark, d)).select("origin", F.col("line_no").cast("long").alias("line_no"), "kind", "prefix")


@query("robots_gate", with_views("o_gate") + """
select id, allow_len, disallow_len, disallow_len = -1 or allow_len >= disallow_len as robots_allowed from o_gate""")
def q_robots_gate(spark, d):
    g = robots_gate(fixtures.tracked(spark, d), robots_rules(fixtures.robots(spark, d)))
    return g.select("id", F.col("allow_len").cast("long").alias("allow_len"),
                    F.col("disallow_len").cast("long").alias("disallow_len"), "robots_allowed")


@query("robots_gate_indexed", ORACLES["robots_gate"])
def q_robots_gate_indexed(spark, d):
    g = robots_gate_indexed(fixtures.tracked(spark, d), robots_rules(fixtures.robots(spark, d)), "id")
    return g.select("id", F.col("allow_len").cast("long").alias("allow_len"),
                    F.col("disallow_len").cast("long").alias("disallow_len"), "robots_allowed")

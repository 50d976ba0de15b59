"""Queries for page cleaning, extraction and dedupe."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.functions.keywords import TECH_KEYWORDS
from jobtrail.operators.clean import clean_pages
from jobtrail.operators.dedupe import content_key, insert_new, keep_first, only_unseen, posting_rows
from jobtrail.operators.extract import (SYSTEM_PROMPT, extract_postings, extraction_requests, fallback_postings,
                                        normalize_candidates, reply_candidates, tag_keywords, tag_many)
from jobtrail.plans.oracle_views import add_view, capitalize_dash, clean_html, collapse, tags, trim_js, with_views
from jobtrail.plans.registry import ORACLES, query
from jobtrail.sources.tables import read_table

# Fixed parameters of the registered queries.
CYCLE_ID = "cycle-0001"
NOW = datetime(2025, 1, 1, 12, 0, 0)
MODEL = "gpt-4o-mini"
CAND_ORDER = fixtures.CANDIDATE_ORDER
PAGE_ORDER = ["added_at", "tracked_url_id", "pos"]


def _joined(col: str, alias: str | None = None):
    return F.array_join(F.col(col), ",").alias(alias or col)


def snapshot_pages(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with their source's URL and order key, HTML cleaned once."""
    s = fixtures.snapshots(spark, d)
    src = fixtures.tracked(spark, d)
    t = src.select(F.col("id").alias("tracked_url_id"), F.col("url").alias("tracked_url"), "added_at")
    j = s.join(t, "tracked_url_id").withColumn("source_url", F.coalesce("final_url", "tracked_url"))
    return clean_pages(j.select("tracked_url_id", "snapshot_id", "page_id", "source_url", "added_at", "html"))


# ------------------------------------------------------------------ M1
@query("clean_pages", with_views("o_pages") + "select page_id, page_text from o_pages")
def q_clean_pages(spark, d):
    return snapshot_pages(spark, d).select("page_id", "page_text")


# markup that never ends, nested forms, a breakout of <svg> and a marked section, put in front of every body
NESTED = ("<div><nav>m</div>A1 <form>f1<form>f2</form>B2 </form>C3 <header>h</header>D4 <svg><title>t</title><p>E5 </p>"
          "<![x[y]]>F6 <table><tr><td><form>q</td></tr></table>G7 ")
NESTED_TEXT = "A1 B2 C3 D4 E5 F6 G7 "


@query("clean_pages_nested", with_views("v_snapshots") + f"""
select page_id, {clean_html(f"replace(html, '<body>', '<body>{NESTED_TEXT}')")} as page_text from v_snapshots""")
def q_clean_pages_nested(spark, d):
    pages = fixtures.snapshots(spark, d).withColumn("html", F.replace("html", F.lit("<body>"), F.lit("<body>" + NESTED)))
    return clean_pages(pages).select("page_id", "page_text")


# text that a table cannot hold stands before the table; what its cells hold stays
TABLES = ("<table>T1 <tr>T2 <td>T3 <table>T4 <tr><td>T5 </td></tr>T6 </table>T7 </td></tr><b>T8 <i>T9 </i></b><caption>T10 </caption>"
          "<form>gone</form><script>gone</script> <tbody><tr><th>T11 </th>T12 </tr></tbody></table>T13 ")
TABLES_TEXT = "T1 T2 T8 T9 T12 T3 T4 T6 T5 T7 T10 T11 T13 "


@query("clean_pages_tables", with_views("v_snapshots") + f"""
select page_id, {clean_html(f"replace(html, '<body>', '<body>{TABLES_TEXT}')")} as page_text from v_snapshots""")
def q_clean_pages_tables(spark, d):
    pages = fixtures.snapshots(spark, d).withColumn("html", F.replace("html", F.lit("<body>"), F.lit("<body>" + TABLES)))
    return clean_pages(pages).select("page_id", "page_text")


# ------------------------------------------------------------------ X1
@query("tag_keywords", with_views("v_docs") + f"select doc_id, {tags('lower(text)')} as tech from v_docs")
def q_tag_keywords(spark, d):
    return tag_keywords(fixtures.docs(spark, d), "text", "tech").select("doc_id", _joined("tech"))


@query("tag_keywords_automaton", ORACLES["tag_keywords"])
def q_tag_keywords_automaton(spark, d):
    return tag_many(fixtures.docs(spark, d), TECH_KEYWORDS, "text", "tech").select("doc_id", _joined("tech"))


# keywords from a table: the part types (a closed vocabulary, however many parts there are)
@query("tag_part_types", """
select l.l_orderkey, l.l_linenumber, lower(p.p_type) as named
from lineitem l join part p on p.p_partkey = l.l_partkey where l.l_linenumber = 1""")
def q_tag_part_types(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_type")
    names = [r[0] for r in part.select(F.lower("p_type")).distinct().orderBy(F.lower("p_type")).collect()]
    li = read_table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey")
    texts = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("order of <"), F.upper("p_type"), F.lit(">, urgent")).alias("text"))
    tagged = tag_many(texts, names, "text", "tech", limit=None)
    # the longest tag is the type itself; types within types are tags, too
    longest = F.array_max(F.transform("tech", lambda t: F.struct(F.length(t).alias("n"), F.lower(t).alias("t"))))
    return tagged.select("l_orderkey", "l_linenumber", longest["t"].alias("named"))


# ------------------------------------------------------------------ X2
add_view("o_fallback", f"""
select tracked_url_id, page_id, added_at, source_url, page_text,
       case when length({trim_js('page_text')}) > 4 and length({trim_js('page_text')}) < 120 then {trim_js('page_text')} else 'Unknown Role' end as job_title,
       coalesce(nullif({capitalize_dash("split_part(regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]*)', 1), '^www\\.', ''), '.', 1)")}, ''), 'Unknown Company') as company_name,
       cast(null as varchar) as salary,
       {tags('lower(page_text)')} as tech,
       case when {collapse('page_text')} = '' then 'No requirement summary available.' else substring({collapse('page_text')}, 1, 550) end as requirements_summary,
       source_url as job_url
from o_pages""", ("o_pages",))


@query("fallback_postings", with_views("o_fallback") +
       "select page_id, job_title, company_name, salary, tech, requirements_summary, job_url from o_fallback")
def q_fallback_postings(spark, d):
    f = fallback_postings(snapshot_pages(spark, d))
    return f.select("page_id", "job_title", "company_name", "salary", _joined("tech_stack", "tech"),
                    "requirements_summary", "job_url")


# ------------------------------------------------------------------ X3
add_view("o_reply", """
select tracked_url_id, raw_content,
       case when raw_content is null or trim(raw_content) = '' or not json_valid(raw_content) then null
            else json_type(raw_content) end as typ,
       case when raw_content is not null and trim(raw_content) <> '' and json_valid(raw_content)
                 and json_type(raw_content) = 'OBJECT' then json_type(raw_content, '$.jobs') end as jobs_typ
from v_replies""", ("v_replies",))
add_view("o_cands", """
select tracked_url_id, i as cand_no, json_extract(raw_content, '$.jobs[' || i || ']') as e
from o_reply, range(0, cast(json_array_length(raw_content, '$.jobs') as bigint)) r(i)
where typ = 'OBJECT' and jobs_typ = 'ARRAY'
union all
select tracked_url_id, 0 as cand_no, cast(raw_content as json) as e
from o_reply where typ = 'ARRAY' or (typ = 'OBJECT' and coalesce(jobs_typ, '') <> 'ARRAY')""", ("o_reply",))


@query("reply_candidates", with_views("o_reply") + """
select r.tracked_url_id,
       case when typ = 'OBJECT' and jobs_typ = 'ARRAY' then 'jobs' when typ in ('OBJECT', 'ARRAY') then 'single' else 'fallback' end as shape,
       case when typ = 'OBJECT' and jobs_typ = 'ARRAY' then cast(json_array_length(raw_content, '$.jobs') as bigint)
            when typ in ('OBJECT', 'ARRAY') then 1 else 0 end as n_candidates
from o_reply r""")
def q_reply_candidates(spark, d):
    r = reply_candidates(fixtures.replies(spark, d))
    jobs_shape = F.col("candidates").isNotNull() & F.try_variant_get(F.try_parse_json(F.col("raw_content")), "$.jobs",
                                                                      "array<variant>").isNotNull()
    return r.select("tracked_url_id",
                    F.when(F.col("candidates").isNull(), "fallback").when(jobs_shape, "jobs").otherwise("single").alias("shape"),
                    F.coalesce(F.size("candidates").cast("long"), F.lit(0).cast("long")).alias("n_candidates"))


@query("reply_candidates_strict", with_views("v_replies") + """
select tracked_url_id, cast(case when i = 0 then 1 else 0 end as bigint) as n_candidates, i as variant from v_replies, range(0, 4) r(i)""")
def q_reply_candidates_strict(spark, d):
    # text behind the value is no JSON, whatever it is
    ends = F.array(F.lit(""), F.lit(" trailing note"), F.lit(", 1"), F.lit("],[2"))
    r = fixtures.replies(spark, d).select("tracked_url_id", F.posexplode(ends).alias("variant", "end"))
    r = r.withColumn("raw_content", F.concat(F.lit('{"jobs":[{"job_title":"A"}]}'), F.col("end")))
    return reply_candidates(r).select("tracked_url_id", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("n_candidates"),
                                      F.col("variant").cast("long").alias("variant"))


# replies that repeat keys: in the reply, in a posting, and escaped
@query("repeated_keys", """
select tracked_url_id, 'Role ' || (page_id % 13) as job_title, case when page_id % 2 = 0 then 'New' else 'Acme' end as company_name
from o_pages_ids""".replace("o_pages_ids", "(select cast(p.page_id as varchar) as tracked_url_id, p.page_id from pages p join events e on e.event_id = p.page_id) x"))
def q_repeated_keys(spark, d):
    no = F.col("page_id")
    role = F.concat(F.lit('"job_title":"old","job_title":"Role '), (no % 13).cast("string"), F.lit('"'))
    company = F.when(no % 2 == 0, F.lit('"company_name":"Old","company_n\\u0061me":"New"')).otherwise(F.lit('"company_name":"Acme"'))
    raw = F.concat(F.lit('{"jobs":[{"job_title":"Gone","company_name":"Gone"}],"jobs":[{'), role, F.lit(","), company, F.lit("}]}"))
    sent = fixtures.replies(spark, d).join(read_table(spark, d, "pages").select("page_id", F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("snapshot_id")), "snapshot_id")
    replies = sent.select("snapshot_id", raw.alias("raw_content"), "replied_at")
    return extract_postings(snapshot_pages(spark, d), replies).select("tracked_url_id", "job_title", "company_name")


# ------------------------------------------------------------------ X4
def _str_field(e: str, name: str) -> str:
    return (f"case when json_type({e}, '$.{name}') = 'VARCHAR' then {collapse(f'json_extract_string({e}, {chr(39)}$.{name}{chr(39)})')} "
            f"else '' end")


add_view("o_norm", f"""
select c.tracked_url_id, c.cand_no,
       json_type(c.e) = 'OBJECT' and {_str_field('c.e', 'job_title')} <> '' and {_str_field('c.e', 'company_name')} <> '' as valid,
       {_str_field('c.e', 'job_title')} as job_title,
       {_str_field('c.e', 'company_name')} as company_name,
       nullif({_str_field('c.e', 'salary')}, '') as salary,
       coalesce(nullif(array_to_string(list_filter(list_transform(
           case when json_type(c.e, '$.tech_stack') = 'ARRAY' then json_extract(c.e, '$.tech_stack[*]') else [] end,
           lambda t: case when json_type(t) = 'VARCHAR' then {collapse("json_extract_string(t, '$')")} else '' end),
           lambda t: t <> '')[1:20], ','), ''), f.tech) as tech,
       coalesce(nullif({_str_field('c.e', 'requirements_summary')}, ''), f.requirements_summary) as requirements_summary,
       coalesce(nullif({_str_field('c.e', 'job_url')}, ''), f.source_url) as job_url,
       f.page_id, f.added_at, f.source_url, f.page_text
from o_cands c join o_fallback f on f.tracked_url_id = c.tracked_url_id""", ("o_cands", "o_fallback"))
add_view("o_valid", """
select * from (select n.*, row_number() over (partition by tracked_url_id order by cand_no) - 1 as pos
               from o_norm n where valid) v where pos < 20""", ("o_norm",))


@query("normalize_candidates", with_views("o_valid") +
       "select tracked_url_id, pos, job_title, company_name, salary, tech, requirements_summary, job_url from o_valid")
def q_normalize_candidates(spark, d):
    pages = snapshot_pages(spark, d)
    r = reply_candidates(pages.join(fixtures.replies(spark, d).drop("tracked_url_id"), "snapshot_id"))
    n = normalize_candidates(r, "candidates", "page_text", "source_url", "valid_postings")
    e = n.select("tracked_url_id", F.posexplode("valid_postings").alias("pos", "p")).select("tracked_url_id", "pos", "p.*")
    return e.select("tracked_url_id", F.col("pos").cast("long").alias("pos"), "job_title", "company_name", "salary",
                    _joined("tech_stack", "tech"), "requirements_summary", "job_url")


# ------------------------------------------------------------------ X5
add_view("o_postings", """
select tracked_url_id, page_id, added_at, source_url, page_text, pos, job_title, company_name, salary, tech, requirements_summary, job_url
from o_valid where page_id % 10 <> 9
union all
select tracked_url_id, page_id, added_at, source_url, page_text, 0 as pos, job_title, company_name, salary, tech, requirements_summary, job_url
from o_fallback f where not exists (select 1 from o_valid v where v.tracked_url_id = f.tracked_url_id and v.page_id % 10 <> 9)""",
         ("o_valid", "o_fallback"))


def page_postings(spark: SparkSession, d: str) -> DataFrame:
    return extract_postings(snapshot_pages(spark, d), fixtures.landed_replies(spark, d))


@query("extract_postings", with_views("o_postings") +
       "select tracked_url_id, pos, job_title, company_name, salary, tech, requirements_summary, job_url from o_postings")
def q_extract_postings(spark, d):
    return page_postings(spark, d).select("tracked_url_id", F.col("pos").cast("long").alias("pos"), "job_title",
                                          "company_name", "salary", _joined("tech_stack", "tech"),
                                          "requirements_summary", "job_url")


# ------------------------------------------------------------------ P14
@query("extraction_requests", with_views("o_pages") + f"""
select tracked_url_id, '{MODEL}' as model, 0 as temperature, 'json_object' as response_format,
       md5(system_prompt) as system_prompt_md5,
       'Source URL: ' || source_url || chr(10) || chr(10) || 'Page text:' || chr(10) || page_text as user_message
from o_pages, (select ? as system_prompt) sp""".replace("?", "'" + SYSTEM_PROMPT.replace("'", "''") + "'"))
def q_extraction_requests(spark, d):
    r = extraction_requests(snapshot_pages(spark, d), MODEL)
    return r.select("tracked_url_id", "model", "temperature", "response_format",
                    F.md5("system_prompt").alias("system_prompt_md5"), "user_message")


# ------------------------------------------------------------------ D1
@query("content_key", with_views("v_keyed") +
       "select source_id, l_orderkey, l_linenumber, l_partkey, job_url, content_hash from v_keyed")
def q_content_key(spark, d):
    k = content_key(fixtures.candidates(spark, d), url_fallback=None)
    return k.select("source_id", "l_orderkey", "l_linenumber", "l_partkey", "job_url", "content_hash")


# ------------------------------------------------------------------ D2
@query("keep_first", with_views("v_keyed") + """
select content_hash, source_id, l_orderkey, l_linenumber, l_partkey, added_at from (
  select k.*, row_number() over (partition by content_hash order by added_at, source_id, l_orderkey, l_linenumber, l_partkey) as rn
  from v_keyed k) x where rn = 1""")
def q_keep_first(spark, d):
    k = keep_first(content_key(fixtures.candidates(spark, d), url_fallback=None), CAND_ORDER)
    return k.select("content_hash", "source_id", "l_orderkey", "l_linenumber", "l_partkey", "added_at")


# ------------------------------------------------------------------ J2 / D3
@query("only_unseen", with_views("v_keyed", "v_known_jobs") + """
select content_hash, source_id, l_orderkey, l_linenumber, l_partkey from v_keyed k
where not exists (select 1 from v_known_jobs j where j.content_hash = k.content_hash)""")
def q_only_unseen(spark, d):
    k = content_key(fixtures.candidates(spark, d), url_fallback=None)
    return only_unseen(k, fixtures.known_jobs(spark, d)).select("content_hash", "source_id", "l_orderkey", "l_linenumber", "l_partkey")


# ------------------------------------------------------------------ P13
@query("posting_rows", with_views("v_keyed") + f"""
select content_hash, source_id as tracked_url_id, {trim_js('job_title')} as job_title, {trim_js('company_name')} as company_name,
       nullif({trim_js('salary')}, '') as salary, array_to_string(tech_stack[1:20], ',') as tech,
       substring({collapse('requirements_summary')}, 1, 1200) as requirements_summary, job_url,
       substring(requirements_summary || ' ' || job_title, 1, 14000) as raw_text
from v_keyed""")
def q_posting_rows(spark, d):
    k = content_key(fixtures.candidates(spark, d), url_fallback=None)
    k = k.withColumn("tracked_url_id", F.col("source_id")).withColumn(
        "raw", F.concat(F.col("requirements_summary"), F.lit(" "), F.col("job_title")))
    r = posting_rows(k, "raw")
    return r.select("content_hash", "tracked_url_id", "job_title", "company_name", "salary", _joined("tech_stack", "tech"),
                    "requirements_summary", "job_url", "raw_text")


# ------------------------------------------------------------------ D4
@query("insert_new", with_views("v_keyed", "v_known_jobs") + f"""
select content_hash, source_id as tracked_url_id, job_title, company_name, nullif({trim_js('salary')}, '') as salary,
       array_to_string(tech_stack[1:20], ',') as tech, substring({collapse('requirements_summary')}, 1, 1200) as requirements_summary,
       job_url, timestamp '{NOW:%Y-%m-%d %H:%M:%S}' as first_seen_at, '{CYCLE_ID}' as cycle_id
from (select k.*, row_number() over (partition by content_hash order by added_at, source_id, l_orderkey, l_linenumber, l_partkey) as rn
      from v_keyed k) x
where rn = 1 and content_hash not in (select content_hash from v_known_jobs)""")
def q_insert_new(spark, d):
    c = fixtures.candidates(spark, d).withColumn("tracked_url_id", F.col("source_id")).withColumn("raw", F.lit(""))
    n = insert_new(c, fixtures.known_jobs(spark, d), CAND_ORDER, CYCLE_ID, NOW, raw_text_col="raw", url_fallback=None)
    return n.select("content_hash", "tracked_url_id", "job_title", "company_name", "salary", _joined("tech_stack", "tech"),
                    "requirements_summary", "job_url", "first_seen_at", "cycle_id")


# ------------------------------------------------------------------ flagship: pages -> postings -> keep-first
@query("page_postings_first", with_views("o_postings") + """
select content_hash, job_title, company_name, job_url, tech from (
  select p.*, sha256(lower(job_title) || '|' || lower(company_name) || '|' || lower(job_url)) as content_hash,
         row_number() over (partition by sha256(lower(job_title) || '|' || lower(company_name) || '|' || lower(job_url))
                            order by added_at, tracked_url_id, pos) as rn
  from o_postings p) x where rn = 1""")
def q_page_postings_first(spark, d):
    k = keep_first(content_key(page_postings(spark, d)), PAGE_ORDER)
    return k.select("content_hash", "job_title", "company_name", "job_url", _joined("tech_stack", "tech"))

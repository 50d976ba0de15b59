"""DuckDB text of the fixture views and shared steps, used to build the oracle SQL.

Each entry is ``name -> (body, dependencies)``; ``with_views`` emits a WITH
clause holding a view and everything it needs, in dependency order. The SQL is
written independently of the Spark code (FIXTURES.md section 3 and 5).
"""

from __future__ import annotations

from jobtrail.functions.keywords import TECH_KEYWORDS

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def trim_js(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# How each keyword is shown, in the order of the keyword list.
SHOWN = ["Python", "Javascript", "Typescript", "React", "Node.Js", "Next.Js", "Postgresql", "Mysql", "Mongodb", "Redis", "Docker",
         "Kubernetes", "Aws", "Gcp", "Azure", "Terraform", "Graphql", "Rest Api", "Java", "Go", "Rust", "C++", "C#", ".Net"]


def kw_list() -> str:
    items = ", ".join(f"{{'kw': '{k}', 'd': '{d}'}}" for k, d in zip(TECH_KEYWORDS, SHOWN, strict=True))
    return f"[{items}]"


def tags(lower_text: str) -> str:
    """Comma-joined display forms of the keywords in an already lower-cased text."""
    return (f"array_to_string(list_transform(list_filter({kw_list()}, lambda k: contains({lower_text}, k.kw)), "
            f"lambda k: k.d)[1:12], ',')")


def capitalize_dash(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, '-'), lambda p: upper(p[1]) || p[2:]), '-')"


def clean_html(h: str) -> str:
    s = f"regexp_replace({h}, '(?is)<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<head\\b.*?</head>', '', 'g')"
    for tag in ("script", "style", "nav", "footer"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b.*?(</{tag}\\s*>|$)', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&amp;?", "&")):
        s = f"regexp_replace({s}, '{ent}', '{ch}', 'g')"
    return f"substring({collapse(s)}, 1, 14000)"


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_tracked": ("""
select cast(p.page_id as varchar) as id,
       case when p.page_id % 11 = 0 then concat('https://www.LinkedIn.com/jobs/', cast(p.page_id as varchar)) else p.url end as url,
       case when p.page_id % 3 = 0 then null when p.page_id % 7 = 1 then '' else concat('src ', cast(p.page_id % 7 as varchar)) end as label,
       case when p.page_id % 11 = 0 then 'linkedin' else 'company_page' end as source_type,
       e.ts as added_at, cast(null as timestamp) as last_scraped_at, 'pending' as last_scrape_status
from pages p join events e on e.event_id = p.page_id""", ()),
    "v_snapshots": ("""
select cast(page_id as varchar) as tracked_url_id, page_id,
       case when page_id % 4 = 0 then concat('https://careers.acme-', cast(page_id % 5 as varchar), '.example/jobs/', cast(page_id as varchar)) else url end as final_url,
       html, case when page_id % 17 = 0 then 503 else 200 end as http_status,
       case when page_id % 23 = 0 then 'This operation was aborted' else null end as error
from pages""", ()),
    "v_landed": ("select * from v_snapshots where page_id % 29 <> 28", ("v_snapshots",)),
    "v_robots": ("""
select origin, case when length(origin) % 6 = 5 then 404 else 200 end as http_status,
       case length(origin) % 6
         when 0 then concat('User-agent: *', chr(10), 'Disallow: /en', chr(10), 'Allow: /en/4 # ok')
         when 1 then concat('User-agent: *', chr(10), 'User-agent: other', chr(10), 'Disallow: /')
         when 2 then concat('# none', chr(10), 'user-agent: *', chr(10), 'Disallow:')
         when 3 then concat('User-agent: other', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'disallow: /es', chr(10), 'allow: /es')
         when 4 then concat('User-agent: *', chr(10), 'Disallow: /')
         else 'User-agent: *' end as body
from (select distinct regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin from pages) o""", ()),
    "v_replies": ("""
select cast(page_id as varchar) as tracked_url_id,
  case page_id % 9
    when 0 then null
    when 1 then '  '
    when 2 then 'not json'
    when 3 then '{"jobs":[]}'
    when 4 then concat('{"job_title":" Role  ', cast(page_id % 13 as varchar), ' ","company_name":"Acme","salary":5,"tech_stack":["Go"," ",7,"C#"]}')
    when 5 then concat('{"jobs":[{"job_title":"Role ', cast(page_id % 13 as varchar), '","company_name":"Acme","salary":" 10k ","requirements_summary":"a  b","job_url":"https://acme.example/', cast(page_id % 5 as varchar), '"},null,"x",{"job_title":7,"company_name":"Acme"},{"job_title":"R2","company_name":"Beta","tech_stack":[]}]}')
    when 6 then '[{"job_title":"A","company_name":"B"}]'
    when 7 then '{"jobs":"x","job_title":"Solo","company_name":"Gamma"}'
    else '7' end as raw_content
from pages""", ()),
    "v_candidates": ("""
select cast(l_suppkey as varchar) as source_id, l_shipdate as added_at, l_orderkey, l_linenumber, l_partkey,
       p_name as job_title, s_name as company_name,
       case when p_size % 4 = 0 then null else concat(cast(p_size as varchar), 'k') end as salary,
       string_split(concat('Python,', p_type, case when p_size % 3 = 0 then ',Node.Js' else '' end), ',') as tech_stack,
       concat('Needs  ', p_type, ' ', p_brand) as requirements_summary,
       concat('https://', lower(replace(s_name, '#', '-')), '.example/', cast(l_linenumber as varchar)) as job_url
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""", ()),
    "v_keyed": ("""
select v.*, sha256(concat(lower(job_title), '|', lower(company_name), '|', lower(job_url))) as content_hash
from v_candidates v""", ("v_candidates",)),
    "v_supplier_sources": ("""
select cast(s_suppkey as varchar) as id, concat('https://', lower(replace(s_name, '#', '-')), '.example/') as url,
       case when s_suppkey % 2 = 0 then null else concat('Label ', s_name) end as label, 'company_page' as source_type
from supplier""", ()),
    "v_jobs": ("""
select content_hash, source_id as tracked_url_id, job_title, company_name, salary, tech_stack, requirements_summary, job_url, added_at as first_seen_at
from (select c.*, row_number() over (partition by content_hash order by added_at, source_id, l_orderkey, l_linenumber, l_partkey) as rn
      from v_keyed c) d
where rn = 1""", ("v_keyed",)),
    "v_known_jobs": ("select distinct content_hash from v_keyed where l_orderkey % 3 = 0", ("v_keyed",)),
    "v_attempts": ("""
select cast(user_id as varchar) as source_id, event_id, ts, case when event_type = 'error' then 'failed' else 'success' end as status
from events""", ()),
    "v_docs": ("""
select doc_id, concat(text, ' ', case doc_id % 6 when 0 then 'JavaScript' when 1 then 'C++ and C#' when 2 then '.NET REST API' when 3 then 'MongoDB, Rust' when 4 then 'python typescript react node.js next.js postgresql mysql mongodb redis docker kubernetes aws gcp azure' else '' end) as text
from documents""", ()),
    "v_submissions": ("""
select page_id as submit_no,
  case page_id % 6 when 0 then concat('  ', url, ' ') when 1 then concat('HTTPS://WWW.Example.COM:443', case when page_id % 4 = 1 then '' else concat('/a/../b/', cast(page_id % 8 as varchar)) end)
    when 2 then 'not a url' when 3 then '   ' when 4 then null else url end as url,
  case when page_id % 5 = 0 then '  ' else concat(' L', cast(page_id as varchar), ' ') end as label,
  case when page_id % 7 = 0 then 'linkedin' else null end as source_type
from pages""", ()),
    # cleaned page text of every snapshot, with its source URL (final URL after redirects)
    "o_pages": (f"""
select s.tracked_url_id, s.page_id, coalesce(s.final_url, t.url) as source_url, t.added_at,
       {clean_html('s.html')} as page_text
from v_snapshots s join v_tracked t on t.id = s.tracked_url_id""", ("v_snapshots", "v_tracked")),
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]}\n)" for n in order) + "\n"


def add_view(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (body, deps)

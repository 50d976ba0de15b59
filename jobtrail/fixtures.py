"""Input views derived from the given test tables (FIXTURES.md section 3).

They turn TPC-H-like and web tables into the shapes the pipeline consumes:
sources, page snapshots, robots bodies, model replies, candidates, stored
postings, an attempt log, documents with keywords and URL submissions.
All are lazy DataFrames over the parquet files, so they grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.sources.tables import read_table

NL = "\n"
# When the pages, robots bodies and replies were fetched.
FETCHED = "timestamp_ntz '2025-01-01 11:00:00'"


def _s(c):
    return c.cast("string")


def tracked(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").select("page_id", "url")
    e = read_table(spark, d, "events").select("event_id", "ts")
    pid = F.col("page_id")
    return p.join(e, e["event_id"] == p["page_id"]).select(
        _s(pid).alias("id"),
        F.when(pid % 11 == 0, F.concat(F.lit("https://www.LinkedIn.com/jobs/"), _s(pid))).otherwise(F.col("url")).alias("url"),
        F.when(pid % 3 == 0, F.lit(None).cast("string")).when(pid % 7 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("src "), _s(pid % 7))).alias("label"),
        F.when(pid % 11 == 0, F.lit("linkedin")).otherwise(F.lit("company_page")).alias("source_type"),
        F.col("ts").alias("added_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"),
        F.lit("pending").alias("last_scrape_status"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    return read_table(spark, d, "pages").select(
        F.concat(F.lit("s"), _s(pid)).alias("snapshot_id"), _s(pid).alias("tracked_url_id"), F.expr(FETCHED).alias("fetched_at"), pid,
        F.when(pid % 4 == 0, F.concat(F.lit("https://careers.acme-"), _s(pid % 5), F.lit(".example/jobs/"), _s(pid)))
         .otherwise(F.col("url")).alias("final_url"),
        "html",
        F.when(pid % 17 == 0, F.lit(503)).otherwise(F.lit(200)).alias("http_status"),
        F.when(pid % 23 == 0, F.lit("This operation was aborted")).otherwise(F.lit(None).cast("string")).alias("error"),
    )


def landed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots of a cycle in which some sources have none."""
    return snapshots(spark, d).where(F.col("page_id") % 29 != 28)


def backlog_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two visits of every source: an older one that failed, and the landed one."""
    new = landed_snapshots(spark, d)
    old = new.withColumns({"snapshot_id": F.concat(F.lit("old-"), F.col("snapshot_id")), "fetched_at": F.expr(FETCHED) - F.expr("interval 1 hour"),
                           "http_status": F.lit(500), "error": F.lit("older visit")})
    return old.unionByName(new)


def robots(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "pages").select(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin")).distinct()
    k = F.length("origin") % 6
    body = (F.when(k == 0, F.lit("User-agent: *" + NL + "Disallow: /en" + NL + "Allow: /en/4 # ok"))
             .when(k == 1, F.lit("User-agent: *" + NL + "User-agent: other" + NL + "Disallow: /"))
             .when(k == 2, F.lit("# none" + NL + "user-agent: *" + NL + "Disallow:"))
             .when(k == 3, F.lit("User-agent: other" + NL + "Disallow: /" + NL + "User-agent: *" + NL
                                 + "disallow: /es" + NL + "allow: /es"))
             .when(k == 4, F.lit("User-agent: *" + NL + "Disallow: /"))
             .otherwise(F.lit("User-agent: *")))
    return o.select("origin", F.when(k == 5, F.lit(404)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"), F.expr(FETCHED).alias("fetched_at"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    m13 = _s(pid % 13)
    k = pid % 9
    raw = (F.when(k == 0, F.lit(None).cast("string"))
            .when(k == 1, F.lit("  "))
            .when(k == 2, F.lit("not json"))
            .when(k == 3, F.lit('{"jobs":[]}'))
            .when(k == 4, F.concat(F.lit('{"job_title":" Role  '), m13,
                                   F.lit(' ","company_name":"Acme","salary":5,"tech_stack":["Go"," ",7,"C#"]}')))
            .when(k == 5, F.concat(F.lit('{"jobs":[{"job_title":"Role '), m13,
                                   F.lit('","company_name":"Acme","salary":" 10k ","requirements_summary":"a  b","job_url":"https://acme.example/'),
                                   _s(pid % 5),
                                   F.lit('"},null,"x",{"job_title":7,"company_name":"Acme"},{"job_title":"R2","company_name":"Beta","tech_stack":[]}]}')))
            .when(k == 6, F.lit('[{"job_title":"A","company_name":"B"}]'))
            .when(k == 7, F.lit('{"jobs":"x","job_title":"Solo","company_name":"Gamma"}'))
            .otherwise(F.lit("7")))
    return read_table(spark, d, "pages").select(F.concat(F.lit("s"), _s(pid)).alias("snapshot_id"), _s(pid).alias("tracked_url_id"),
                                               raw.alias("raw_content"), F.expr(FETCHED).alias("replied_at"))


def landed_replies(spark: SparkSession, d: str) -> DataFrame:
    """The replies of a cycle in which some pages have none."""
    return replies(spark, d).where(F.col("tracked_url_id").cast("long") % 10 != 9)


def backlog_replies(spark: SparkSession, d: str) -> DataFrame:
    """Two replies to every snapshot: an older one, and the landed one."""
    new = landed_replies(spark, d)
    old = new.withColumns({"raw_content": F.lit('[{"job_title":"Old","company_name":"Old"}]'), "replied_at": F.expr(FETCHED) - F.expr("interval 1 hour")})
    return old.unionByName(new)


def offers(spark: SparkSession, d: str) -> DataFrame:
    """What the candidates are made of: line items with the columns of their supplier and part (the narrower table first)."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("added_at"))
    pa = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    su = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    j = li.join(su, li["l_suppkey"] == su["s_suppkey"]).join(pa, li["l_partkey"] == pa["p_partkey"])
    return j.select(_s(F.col("l_suppkey")).alias("source_id"), "added_at", "l_orderkey", "l_linenumber", "l_partkey",
                    "p_name", "p_type", "p_size", "p_brand", "s_name")


def _posting_columns() -> dict:
    """The posting columns of a candidate, made of its offer."""
    return {
        "job_title": F.col("p_name"), "company_name": F.col("s_name"),
        "salary": F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(_s(F.col("p_size")), F.lit("k"))),
        "tech_stack": F.split(F.concat(F.lit("Python,"), F.col("p_type"),
                                       F.when(F.col("p_size") % 3 == 0, F.lit(",Node.Js")).otherwise(F.lit(""))), ","),
        "requirements_summary": F.concat(F.lit("Needs  "), F.col("p_type"), F.lit(" "), F.col("p_brand")),
        "job_url": F.concat(F.lit("https://"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))), F.lit(".example/"),
                            _s(F.col("l_linenumber"))),
    }


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("source_id", "added_at", "l_orderkey", "l_linenumber", "l_partkey",
                                   *[c.alias(n) for n, c in _posting_columns().items()])


def supplier_sources(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    return s.select(
        _s(F.col("s_suppkey")).alias("id"),
        F.concat(F.lit("https://"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))), F.lit(".example/")).alias("url"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Label "), F.col("s_name"))).alias("label"),
        F.lit("company_page").alias("source_type"),
    )


CANDIDATE_ORDER = ["added_at", "source_id", "l_orderkey", "l_linenumber", "l_partkey"]


def first_offers(rows: DataFrame) -> DataFrame:
    """The offers whose candidates come first under their content key. Ranked before the postings are made of them and
    before the key's text is hashed: what moves is narrow, and the text compresses beside the columns it is made of."""
    from jobtrail.functions.text import trim_js
    from jobtrail.operators.dedupe import keep_first, key_text

    made = _posting_columns()
    key = key_text(made["job_title"], made["company_name"], trim_js(made["job_url"]))
    return keep_first(rows.withColumn("_key", key), CANDIDATE_ORDER, key="_key").drop("_key")


def as_postings(firsts: DataFrame, *extra: str) -> DataFrame:
    """The stored postings of first offers, with ``extra`` columns of theirs."""
    from jobtrail.operators.dedupe import content_key

    rows = firsts.select("source_id", "added_at", *extra, *[c.alias(n) for n, c in _posting_columns().items()])
    return content_key(rows, url_fallback=None).select(
        "content_hash", F.col("source_id").alias("tracked_url_id"), "job_title", "company_name", "salary",
        "tech_stack", "requirements_summary", "job_url", F.col("added_at").alias("first_seen_at"), *extra)


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored history: the keep-first rows of all candidates."""
    return as_postings(first_offers(offers(spark, d)))


def known_jobs(spark: SparkSession, d: str) -> DataFrame:
    """An earlier state of the history, so that candidates are partly known: those of every third order."""
    return as_postings(first_offers(offers(spark, d).where(F.col("l_orderkey") % 3 == 0)))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(_s(F.col("user_id")).alias("source_id"), "event_id", "ts",
                    F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("success")).alias("status"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    extra = (F.when(k == 0, F.lit("JavaScript")).when(k == 1, F.lit("C++ and C#")).when(k == 2, F.lit(".NET REST API"))
              .when(k == 3, F.lit("MongoDB, Rust"))
              .when(k == 4, F.lit("python typescript react node.js next.js postgresql mysql mongodb redis docker "
                                  "kubernetes aws gcp azure"))
              .otherwise(F.lit("")))
    return read_table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" "), extra).alias("text"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    k = pid % 6
    url = (F.when(k == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
            .when(k == 1, F.concat(F.lit("HTTPS://WWW.Example.COM:443"),
                                   F.when(pid % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("/a/../b/"), _s(pid % 8)))))
            .when(k == 2, F.lit("not a url")).when(k == 3, F.lit("   ")).when(k == 4, F.lit(None).cast("string"))
            .otherwise(F.col("url")))
    return read_table(spark, d, "pages").select(
        pid.alias("submit_no"), url.alias("url"),
        F.when(pid % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" L"), _s(pid), F.lit(" "))).alias("label"),
        F.when(pid % 7 == 0, F.lit("linkedin")).otherwise(F.lit(None).cast("string")).alias("source_type"),
    )

"""P8-P12, L1-L3."""

from datetime import datetime

from pyspark.sql import functions as F

from jobtrail.operators.search import date_range, display_view, newest, normalize_result, search, text_filter, with_source

JOBS = ("content_hash string, tracked_url_id string, job_title string, company_name string, salary string, "
        "tech_stack array<string>, requirements_summary string, job_url string, raw_text string, first_seen_at timestamp_ntz")
SRC = "id string, url string, label string, source_type string"


def jobs(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def j(h, ts, tech=("Go",), company="Acme", title="Engineer", src="1", salary=None):
    return (h, src, title, company, salary, list(tech), "s", "u", "r", ts)


def srcs(spark):
    return spark.createDataFrame([("1", "https://acme.example/", "Label %", "company_page"),
                                  ("2", "https://b.example/", None, "company_page")], SRC)


def test_limit_applies_before_tech_filter(spark):
    rows = [j("a", datetime(2024, 1, 3), ["Go"]), j("b", datetime(2024, 1, 2), ["Go"]), j("c", datetime(2024, 1, 1), ["Rust"])]
    assert search(jobs(spark, rows), srcs(spark), tech="rust", limit="2").count() == 0
    assert search(jobs(spark, rows), srcs(spark), tech="rust", limit="2", filter_first=True).count() == 1
    assert [r.content_hash for r in search(jobs(spark, rows), srcs(spark), limit="2").collect()] == ["a", "b"]


def test_haystack_spans_fields_and_literal_needles(spark):
    rows = [j("a", datetime(2024, 1, 1), company="Acme", title="Engineer"), j("b", datetime(2024, 1, 1), company="X_Y", src="2")]
    df = with_source(jobs(spark, rows), srcs(spark))
    assert [r.content_hash for r in text_filter(df, "acme eng").collect()] == ["a"]
    assert [r.content_hash for r in text_filter(df, "%").collect()] == ["a"]
    assert [r.content_hash for r in text_filter(df, "_").collect()] == ["b"]


def test_day_end_inclusive_to_the_millisecond(spark):
    rows = [j("in", datetime(2024, 5, 1, 23, 59, 59, 999000)), j("out", datetime(2024, 5, 1, 23, 59, 59, 999500)),
            j("next", datetime(2024, 5, 2))]
    got = {r.content_hash for r in date_range(jobs(spark, rows), "2024-05-01", "2024-05-01").collect()}
    assert got == {"in"}
    assert date_range(jobs(spark, rows), "nope", "").count() == 3


def test_normalize_and_display(spark):
    rows = [j("a", datetime(2024, 1, 1), tech=["", "Go"], salary="", src="2"), j("b", datetime(2024, 1, 1), tech=[], src="9")]
    out = {r.content_hash: r for r in display_view(normalize_result(with_source(jobs(spark, rows), srcs(spark)))).collect()}
    assert out["a"].salary is None and out["a"].tech_stack == ["Go"] and out["a"].source_display == "https://b.example/"
    assert out["b"].tracked_urls is None and out["b"].source_display == "Unknown source"
    assert out["b"].tech_display == ["Not specified"] and out["b"].salary_display == "Salary not specified"


def test_search_subset_of_newest(spark):
    from tests.conftest import SF_SMALL
    from jobtrail import fixtures

    jb, s = fixtures.jobs(spark, SF_SMALL), fixtures.supplier_sources(spark, SF_SMALL)
    top = {r.content_hash for r in newest(jb, 100).collect()}
    got = {r.content_hash for r in search(jb, s, tech="python", company_or_source="supplier", limit="100").collect()}
    assert got and got <= top


def test_date_filter_reaches_the_scan(spark, scratch):
    from jobtrail.sources.tables import write_postings

    rows = [j("a", datetime(2024, 1, 1)), j("b", datetime(2024, 6, 1))]
    df = jobs(spark, rows).withColumn("id", F.col("content_hash"))
    write_postings(df, scratch + "/postings")
    stored = spark.read.parquet(scratch + "/postings")
    cols = ["content_hash", "tracked_url_id", "first_seen_at", "tech_stack", "job_title", "company_name", "salary"]
    # the plan that feeds the materialized top-N: partition filter, pushed filter, no raw_text
    top = newest(date_range(stored.select(*cols, "first_seen_date"), "2024-05-01"), 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first_seen_date" in plan and "PushedFilters: [IsNotNull(first_seen_at)" in plan
    assert "raw_text" not in plan
    q = search(stored, srcs(spark), start_date="2024-05-01", columns=cols)
    assert [r.content_hash for r in q.collect()] == ["b"]


def test_trigram_search_equals_the_filter(spark, scratch):
    import random
    from datetime import date

    from jobtrail.operators.search import text_candidates, text_filter, text_search, trigram_index, with_source

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 9)))
    jobs = spark.createDataFrame([(f"h{i}", str(i % 5), word().upper(), word(), date(2024, 1, 1 + i % 20)) for i in range(400)] + [("hx", "9", None, None, date(2024, 3, 1))],
                                 "content_hash string, tracked_url_id string, company_name string, job_title string, first_seen_date date")
    sources = spark.createDataFrame([(str(i), f"https://s{i}.example", None if i % 2 else "Lbl", "company_page") for i in range(5)], "id string, url string, label string, source_type string")
    jobs.write.partitionBy("first_seen_date").parquet(f"{scratch}/p")
    stored = spark.read.parquet(f"{scratch}/p")
    trigram_index(with_source(stored, sources)).write.parquet(f"{scratch}/i")
    index = spark.read.parquet(f"{scratch}/i")
    for needle in ("abc", "ABCA", "é a", "s3.example lbl", "a https", "no such text", "ab", "", None, "aaaa"):
        want = sorted(r.content_hash for r in text_filter(with_source(stored, sources), needle).collect())
        assert sorted(r.content_hash for r in text_search(stored, sources, index, needle).collect()) == want, needle
    some = text_search(stored, sources, index, "abca")
    days = {r.first_seen_date for r in text_candidates(index, "abca").collect()}
    filters = some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert len(days) < 21 and all(str(d) in filters for d in days)


def test_trigram_candidates_need_no_shuffle(spark):
    from jobtrail.operators.search import text_candidates, trigram_index, with_source

    rows = jobs(spark, [j("a", datetime(2024, 1, 1)), j("b", datetime(2024, 6, 1))]).withColumn("first_seen_date", F.to_date("first_seen_at"))
    index = trigram_index(with_source(rows, srcs(spark)))
    assert index.columns == ["content_hash", "first_seen_date", "trigrams"] and index.count() == 2  # one row a posting
    index = index.localCheckpoint()
    found = text_candidates(index, "no such words")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
    assert text_candidates(index, "http").count() == 2

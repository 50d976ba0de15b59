"""Keyword tagging, fallback posting, reply shapes."""

import json

from pyspark.sql import functions as F

from jobtrail.functions.keywords import TECH_KEYWORDS
from jobtrail.operators.extract import (NO_SUMMARY, UNKNOWN_ROLE, extract_postings,
                                        extraction_requests, fallback_postings, tag_keywords)


def tags(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return tag_keywords(df, "text", "t").first().t


def test_keywords_substring_list_order(spark):
    assert tags(spark, "JavaScript on MongoDB") == ["Javascript", "Mongodb", "Java", "Go"]
    assert tags(spark, "C++ and C# on .NET with a REST API") == ["Rest Api", "C++", "C#", ".Net"]
    assert tags(spark, " ".join(TECH_KEYWORDS)) == [
        "Python", "Javascript", "Typescript", "React", "Node.Js", "Next.Js", "Postgresql", "Mysql", "Mongodb",
        "Redis", "Docker", "Kubernetes"]
    assert tags(spark, "") == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "tracked_url_id string, source_url string, page_text string, added_at timestamp_ntz")


def test_fallback_title_bounds_and_company(spark):
    rows = [("1", "https://www.my-co.com/x", "abcd", None), ("2", "https://careers.acme.com/", "abcde", None),
            ("3", "https://x.example/", "y" * 119, None), ("4", "https://x.example/", "y" * 120, None),
            ("5", "https://x.example/", "", None), ("6", "https://x.example/", "Data Engineer", None)]
    got = {r.tracked_url_id: r for r in fallback_postings(pages(spark, rows)).collect()}
    assert got["1"].job_title == UNKNOWN_ROLE and got["1"].company_name == "My-Co"
    assert got["2"].job_title == "abcde" and got["2"].company_name == "Careers"
    assert got["3"].job_title == "y" * 119 and got["4"].job_title == UNKNOWN_ROLE
    assert got["5"].requirements_summary == NO_SUMMARY and got["5"].salary is None
    assert got["6"].job_title == "Data Engineer" and got["6"].job_url == "https://x.example/"


LONG = "Python page with Go " + "filler " * 20


def run(spark, reply, text=LONG):
    p = pages(spark, [("1", "https://acme.example/jobs", text, None)]).withColumn("snapshot_id", F.lit("s1"))
    old = '[{"job_title":"Old","company_name":"Old"}]'
    r = spark.createDataFrame([("s1", old, 1), ("s1", reply, 2), ("s1", reply, 2), ("s2", old, 3)], "snapshot_id string, raw_content string, replied_at int")
    return sorted(extract_postings(p, r).collect(), key=lambda x: x.pos)


def test_reply_shapes_go_to_fallback(spark):
    for reply in [None, "  ", "not json", "null", "7", '"s"', "true", '{"jobs":[{"job_title":"A","company_name":"B"}]} trailing note',
                  '{"job_title":"A","company_name":"B"},1', '{"job_title":"A","company_name":"B"}],[1', '{"jobs":[]}', '[{"job_title":"A","company_name":"B"}]',
                  '{"job_title":5,"company_name":"A"}', '{"jobs":[null,"x",{"job_title":"","company_name":"B"}]}']:
        out = run(spark, reply)
        assert len(out) == 1 and out[0].job_title == UNKNOWN_ROLE and out[0].company_name == "Acme", reply


def test_object_without_jobs_array_is_one_candidate(spark):
    out = run(spark, '{"jobs":"x","job_title":"Solo","company_name":"Gamma"}')
    assert [(o.pos, o.job_title, o.company_name) for o in out] == [(0, "Solo", "Gamma")]


def test_candidate_normalization(spark):
    reply = json.dumps({"job_title": " Role  9 ", "company_name": "Acme", "salary": 5, "tech_stack": ["Go", " ", 7, "C#"]})
    (o,) = run(spark, reply)
    assert (o.job_title, o.salary, o.tech_stack, o.job_url) == ("Role 9", None, ["Go", "C#"], "https://acme.example/jobs")
    assert o.requirements_summary == LONG.strip()
    (o,) = run(spark, json.dumps({"job_title": "R", "company_name": "B", "tech_stack": [], "salary": " 10k ",
                                  "requirements_summary": "a  b", "job_url": " https://u "}))
    assert (o.tech_stack, o.salary, o.requirements_summary, o.job_url) == (["Python", "Go"], "10k", "a b", "https://u")


def test_first_20_valid_after_dropping_invalid(spark):
    jobs = []
    for i in range(30):
        jobs.append({"job_title": f"T{i}", "company_name": "C"} if i % 6 else {"job_title": 1, "company_name": "C"})
    out = run(spark, json.dumps({"jobs": jobs}))
    valid = [f"T{i}" for i in range(30) if i % 6][:20]
    assert [o.job_title for o in out] == valid and [o.pos for o in out] == list(range(20))


def test_no_replies_means_fallback(spark):
    p = pages(spark, [("1", "https://acme.example/", "Short role", None)])
    (o,) = extract_postings(p, None).collect()
    assert o.job_title == "Short role" and o.pos == 0


def test_extraction_request_shape(spark):
    p = pages(spark, [("1", "https://acme.example/", "text", None)])
    r = extraction_requests(p, "m").first()
    assert r.user_message == "Source URL: https://acme.example/\n\nPage text:\ntext"
    assert r.temperature == 0 and r.response_format == "json_object" and r.system_prompt.startswith("Extract job postings")


def test_automaton_equals_flat_tests(spark):
    import random

    from jobtrail.functions.keywords import TECH_KEYWORDS
    from jobtrail.operators.extract import tag_keywords, tag_many

    rnd = random.Random(1)
    many = ["".join(rnd.choice("abcde .+#") for _ in range(rnd.randrange(1, 7))) for _ in range(20_000)] + ["été", "Go", "go", ""]
    texts = ["".join(rnd.choice("abcde .+#GOÉT") for _ in range(rnd.randrange(0, 400))) for _ in range(30)] + ["", None, "Python and Node.JS, c++/C#", "ÉTÉ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for words, limit in ((TECH_KEYWORDS, 12), (TECH_KEYWORDS, None), (TECH_KEYWORDS, 1)):
        a = {r.i: r.tech for r in tag_keywords(df, keywords=words, limit=limit).collect()}
        b = {r.i: r.tech for r in tag_many(df, words, limit=limit).collect()}
        assert {i: x for i, x in b.items() if x is not None} == {i: x for i, x in a.items() if texts[i] is not None}
    from jobtrail.functions.keywords import display_form

    found = {r.i: r.tech for r in tag_many(df, many, limit=None).collect()}
    for i, t in enumerate(texts):
        assert found[i] == (None if t is None else [display_form(w) for w in many if w.lower() in t.lower()])


def test_parser_runs_twice_whatever_reads_the_value(spark):
    from jobtrail import fixtures
    from jobtrail.operators.extract import extract_postings

    pages = spark.createDataFrame([("s0", "text", "https://a.example")], "snapshot_id string, page_text string, source_url string")
    replies = spark.createDataFrame([("s0", '{"jobs":[{"job_title":"A","company_name":"B"}]}', None)], "snapshot_id string, raw_content string, replied_at timestamp_ntz")
    out = extract_postings(pages, replies)
    assert [(r.job_title, r.company_name) for r in out.collect()] == [("A", "B")]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("parsejson") + text.count("parse_json") <= 2, text
    narrow = extract_postings(pages, replies, keep_text=False)
    assert "page_text" not in narrow.columns and narrow.drop("pos").collect() == out.drop("page_text", "pos").collect()


def test_whole_texts_and_lists(spark):
    from jobtrail.operators.cuts import WHOLE
    from jobtrail.operators.extract import extract_postings, normalize_candidates, reply_candidates

    jobs = ",".join('{"job_title":"T%d","company_name":"C","tech_stack":[%s]}' % (i, ",".join('"x%d"' % j for j in range(40))) for i in range(50))
    words = " ".join(["python javascript typescript react node.js next.js postgresql mysql mongodb redis docker kubernetes aws gcp"] + ["w"] * 900)
    pages = spark.createDataFrame([("s0", words, "https://a.example"), ("s1", words, "https://b.example")], "snapshot_id string, page_text string, source_url string")
    replies = spark.createDataFrame([("s0", '{"jobs":[%s]}' % jobs, None)], "snapshot_id string, raw_content string, replied_at timestamp_ntz")
    whole = extract_postings(pages, replies, cuts=WHOLE).collect()
    cut = extract_postings(pages, replies).collect()
    assert sum(r.snapshot_id == "s0" for r in whole) == 50 and sum(r.snapshot_id == "s0" for r in cut) == 20
    assert {len(r.tech_stack) for r in whole if r.snapshot_id == "s0"} == {40} and {len(r.tech_stack) for r in cut if r.snapshot_id == "s0"} == {20}
    (a,), (b,) = [r for r in whole if r.snapshot_id == "s1"], [r for r in cut if r.snapshot_id == "s1"]
    assert (len(a.requirements_summary), len(b.requirements_summary), len(b.tech_stack)) == (len(words), 550, 12) and len(a.tech_stack) > 12
    n = normalize_candidates(reply_candidates(pages.join(replies, "snapshot_id")), cuts=WHOLE).first().valid_postings
    assert len(n) == 50 and len(n[0].requirements_summary) == len(words)

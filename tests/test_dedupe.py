"""D1-D4, J2, P13 and the property tests of SURVEY 5.3."""

from datetime import datetime

from pyspark.sql import functions as F

from jobtrail.operators.dedupe import content_key, insert_new, keep_first, only_unseen

T0 = datetime(2024, 1, 1)
NOW = datetime(2025, 1, 1)
SCHEMA = ("tracked_url_id string, added_at timestamp_ntz, pos int, job_title string, company_name string, salary string, "
          "tech_stack array<string>, requirements_summary string, job_url string, source_url string, page_text string")


def cands(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(src, added, pos, title="A", company="B", url="C", salary=None):
    return (src, added, pos, title, company, salary, ["x"], "s", url, "https://src/", "text")


def test_key_value(spark):
    (r,) = content_key(cands(spark, [row("1", T0, 0)])).collect()
    assert r.content_hash == "a52dd81bfd5e4e66d96b9f598382f6cbf8c5c3897654e6ae9055e03620fcf38e"


def test_url_fallback_and_unescaped_join(spark):
    rows = [row("1", T0, 0, url="  "), row("1", T0, 1, title="a|b", company="c"), row("1", T0, 2, title="a", company="b|c")]
    out = content_key(cands(spark, rows)).orderBy("pos").collect()
    assert out[0].job_url == "https://src/"
    assert out[1].content_hash == out[2].content_hash


def test_earlier_source_wins(spark):
    rows = [row("9", T0, 0, salary="old"), row("1", datetime(2024, 2, 1), 0, salary="new")]
    (w,) = keep_first(content_key(cands(spark, rows)), ["added_at", "tracked_url_id", "pos"]).collect()
    assert w.tracked_url_id == "9" and w.salary == "old"


def test_known_key_is_never_updated(spark):
    c = content_key(cands(spark, [row("1", T0, 0, salary="changed")]))
    stored = c.select("content_hash")
    assert only_unseen(c, stored).count() == 0


def test_insert_twice_second_empty(spark):
    c = cands(spark, [row("1", T0, i % 3, title=f"T{i % 4}") for i in range(12)])
    empty = spark.createDataFrame([], "content_hash string")
    first = insert_new(c, empty, ["added_at", "tracked_url_id", "pos"], "c1", NOW)
    rows = first.collect()
    assert len(rows) == 4 and len({r.content_hash for r in rows}) == 4
    assert insert_new(c, first, ["added_at", "tracked_url_id", "pos"], "c2", NOW).count() == 0


def test_row_shape(spark):
    long_summary = "a  " * 1000
    r = cands(spark, [(" 1", T0, 0, " T ", " C ", "  ", ["s%d" % i for i in range(30)], long_summary, "u", "s", "x" * 20000)])
    empty = spark.createDataFrame([], "content_hash string")
    (o,) = insert_new(r, empty, ["added_at", "tracked_url_id", "pos"], "c1", NOW).collect()
    assert (o.job_title, o.company_name, o.salary) == ("T", "C", None)
    assert len(o.tech_stack) == 20 and len(o.requirements_summary) == 1200 and len(o.raw_text) == 14000
    assert o.first_seen_at == NOW and o.cycle_id == "c1" and o.id == o.content_hash


def test_result_independent_of_partitioning(spark):
    from tests.conftest import SF_SMALL
    from jobtrail import fixtures

    c = content_key(fixtures.candidates(spark, SF_SMALL), url_fallback=None)
    a = {tuple(r) for r in keep_first(c, fixtures.CANDIDATE_ORDER).select("content_hash", "l_orderkey", "l_linenumber").collect()}
    b = {tuple(r) for r in keep_first(c.repartition(13), fixtures.CANDIDATE_ORDER)
         .select("content_hash", "l_orderkey", "l_linenumber").collect()}
    assert a == b and len(a) == len({x[0] for x in a})


def test_insert_new_moves_the_key_as_bytes(spark):
    import re

    from jobtrail import fixtures
    from tests.conftest import SF_SMALL

    c = fixtures.candidates(spark, SF_SMALL).withColumn("tracked_url_id", F.col("source_id"))
    key = content_key(c, url_fallback=None).agg(F.min("content_hash")).first()[0]
    # only the very digits of a key are that key
    stored = spark.createDataFrame([(key,), (key.upper(),), ("no digits",), (None,), (key[:-1],)], "content_hash string")
    new = insert_new(c, stored, fixtures.CANDIDATE_ORDER, "c1", NOW, raw_text_col=None, url_fallback=None)
    want = {r[0] for r in content_key(c, url_fallback=None).select("content_hash").distinct().collect()} - {key}
    got = [r[0] for r in new.select("content_hash").collect()]
    assert len(got) == len(want) and set(got) == want
    plan = new._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", plan)
    assert "content_hash" not in moved and moved.count("_key") == 2  # one of the candidates, one of the stored keys


def test_first_offers_equal_the_first_candidates(spark):
    from jobtrail import fixtures
    from tests.conftest import SF_SMALL

    want = keep_first(content_key(fixtures.candidates(spark, SF_SMALL), url_fallback=None), fixtures.CANDIDATE_ORDER)
    cols = ["content_hash", "job_title", "company_name", "salary", "tech_stack", "requirements_summary", "job_url"]
    got = fixtures.jobs(spark, SF_SMALL)
    assert sorted(map(str, got.select("tracked_url_id", *cols).collect())) == sorted(map(str, want.select(F.col("source_id").alias("tracked_url_id"), *cols).collect()))
    # neither the hash nor what is made of an offer is in a shuffle
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window ["):]
    assert "sha2" not in below and "split(" not in below

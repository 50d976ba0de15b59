"""P1-P6, U1-U3."""

from datetime import datetime

from jobtrail.operators.registry import (URL_EXISTS, URL_INVALID, URL_REQUIRED, cascade_postings, register_sources,
                                         remove_sources)

NOW = datetime(2025, 1, 1)
SRC = ("id string, url string, label string, source_type string, added_at timestamp_ntz, last_scraped_at timestamp_ntz, "
       "last_scrape_status string")
SUB = "submit_no long, url string, label string, source_type string"


def test_register_batch(spark):
    existing = spark.createDataFrame([("s0", "https://old.example/", None, "company_page", NOW, None, "pending")], SRC)
    subs = spark.createDataFrame([
        (1, " https://x.LinkedIn.com/ ", " L ", None), (2, "HTTPS://X.LINKEDIN.COM:443", "  ", None),
        (3, "https://old.example", None, None), (4, "   ", None, None), (5, "not a url", None, None),
        (6, None, None, None), (7, "https://new.example/a", None, "company_page")], SUB)
    table, out = register_sources(existing, subs, NOW)
    got = {r.submit_no: r for r in out.collect()}
    assert (got[1].status, got[1].source_type, got[1].label, got[1].url) == ("created", "linkedin", "L", "https://x.linkedin.com/")
    assert got[2].reason == URL_EXISTS and got[3].reason == URL_EXISTS
    assert got[4].reason == URL_REQUIRED and got[6].reason == URL_REQUIRED and got[5].reason == URL_INVALID
    assert got[7].status == "created"
    assert len(got) == 7  # accepted + rejected = submitted
    urls = sorted(r.url for r in table.collect())
    assert urls == ["https://new.example/a", "https://old.example/", "https://x.linkedin.com/"]
    assert {r.last_scrape_status for r in table.collect()} == {"pending"}


def test_remove_and_cascade(spark):
    src = spark.createDataFrame([("a", "u1", None, "company_page", NOW, None, "pending"),
                                 ("b", "u2", None, "company_page", NOW, None, "pending")], SRC)
    req = spark.createDataFrame([(" a ",), ("zzz",), ("  ",)], "id string")
    remaining, out = remove_sources(src, req)
    assert [r.id for r in remaining.collect()] == ["b"]
    assert sorted((r.id, r.status) for r in out.collect()) == [("", "rejected"), ("a", "removed"), ("zzz", "removed")]
    posts = spark.createDataFrame([("h1", "a"), ("h2", "a"), ("h3", "b")], "content_hash string, tracked_url_id string")
    ids = spark.createDataFrame([("a",)], "id string")
    assert [r.content_hash for r in cascade_postings(posts, ids).collect()] == ["h3"]

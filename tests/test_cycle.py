"""P6, P7, J3, C1-C5, G1-G3 on the sf0.001 fixtures and on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.operators import digest as dg
from jobtrail.operators.cycle import apply_status, cycle_failures, cycle_summary, run_cycle, source_outcomes
from tests.conftest import SF_SMALL

NOW = datetime(2025, 1, 1, 12)
SRC = ("id string, url string, label string, source_type string, added_at timestamp_ntz, last_scraped_at timestamp_ntz, "
       "last_scrape_status string")
SNAP = ("snapshot_id string, tracked_url_id string, fetched_at timestamp_ntz, final_url string, html string, http_status int, "
        "error string")
ROB = "origin string, http_status int, body string, fetched_at timestamp_ntz"


def test_browser_route_ignores_status(spark):
    src = spark.createDataFrame([("1", "https://www.linkedin.com/jobs/1", None, "linkedin", NOW, None, "pending"),
                                 ("2", "https://acme.example/jobs", None, "company_page", NOW, None, "pending")], SRC)
    snaps = spark.createDataFrame([("a", "1", NOW, None, "<body>x</body>", 503, None), ("b", "2", NOW, None, "<body>y</body>", 503, None)], SNAP)
    rob = spark.createDataFrame([], ROB)
    got = {r.id: (r.status, r.reason) for r in source_outcomes(src, snaps, rob).collect()}
    assert got == {"1": ("success", None), "2": ("failed", "Static scrape failed with status 503")}


def test_cycle_on_fixtures(spark):
    src = fixtures.tracked(spark, SF_SMALL)
    res = run_cycle(src, fixtures.landed_snapshots(spark, SF_SMALL), fixtures.robots(spark, SF_SMALL),
                    fixtures.landed_replies(spark, SF_SMALL), fixtures.known_jobs(spark, SF_SMALL), "c1", NOW)
    outcomes = res.outcomes.cache()
    s = cycle_summary(outcomes, res.new_rows, NOW, NOW).first()
    n_ok = outcomes.where(F.col("status") == "success").count()
    assert s.scanned_count == src.count() == n_ok + s.failed_count
    assert s.failed_count == cycle_failures(outcomes).count() > 0
    new = res.new_rows.collect()
    assert s.new_jobs_count == len(new) > 0 and len({r.content_hash for r in new}) == len(new)
    after = apply_status(src, outcomes, NOW)
    assert {r.last_scrape_status for r in after.collect()} == {"success", "failed"}
    assert {r.last_scraped_at for r in after.collect()} == {NOW}
    # replay against the stored rows adds nothing
    stored = res.new_rows.select("content_hash")
    again = run_cycle(src, fixtures.landed_snapshots(spark, SF_SMALL), fixtures.robots(spark, SF_SMALL),
                      fixtures.landed_replies(spark, SF_SMALL), stored, "c1", NOW)
    assert again.new_rows.count() == 0
    outcomes.unpersist()


def digest_input(spark, n):
    rows = [("c1", NOW, str(i), i, f"T{i}", "A&B", None, [] if i else ["Go", "C#"], "s" * 300, "https://x/?a=1&b=2",
             "https://src/", NOW) for i in range(n)]
    return spark.createDataFrame(rows, "cycle_id string, added_at timestamp_ntz, tracked_url_id string, pos int, "
                                       "jobTitle string, companyName string, salary string, techStack array<string>, "
                                       "requirementsSummary string, jobUrl string, sourceUrl string, firstSeenAt timestamp_ntz")


def test_digest_subject_plural(spark):
    assert dg.digest_header(digest_input(spark, 1), "cron").first().subject == "Job digest: 1 new role"
    assert dg.digest_header(digest_input(spark, 2), "cron").first().subject == "Job digest: 2 new roles"
    assert dg.digest_header(digest_input(spark, 0), "cron").count() == 0


def test_digest_html_fragments(spark):
    frags = dg.digest_html(digest_input(spark, 2), "manual").orderBy("part", "added_at", "tracked_url_id", "pos").collect()
    doc = "".join(f.html for f in frags)
    assert doc.count("<tr") == 3 and doc.count("<tr>") == 2 and "Trigger: manual | New jobs found: 2" in doc
    assert "A&amp;B" in doc and "https://x/?a=1&amp;b=2" in doc and "Go, C#" in doc and "Not specified" in doc
    assert ">" + "s" * 260 + "</td>" in doc
    assert doc.endswith("</tbody>\n      </table>\n    </div>\n  ")

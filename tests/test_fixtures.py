"""The input views equal the row counts and check values published in FIXTURES.md section 3."""

import pytest
from pyspark.sql import functions as F

from jobtrail import fixtures
from jobtrail.operators.dedupe import content_key, only_unseen
from jobtrail.operators.robots import robots_gate, robots_rules
from tests.conftest import SF_MID, SF_SMALL

COUNTS = {  # view: (sf0.001, sf0.01)
    "tracked": (50, 250), "landed_snapshots": (49, 242), "snapshots": (50, 250), "robots": (40, 97), "landed_replies": (45, 225), "replies": (50, 250),
    "candidates": (6000, 60000), "supplier_sources": (10, 100), "jobs": (2967, 32765), "known_jobs": (1469, 15928),
    "attempts": (1000, 10000), "docs": (200, 1000), "submissions": (50, 250),
}


@pytest.mark.parametrize("view", sorted(COUNTS))
def test_view_row_counts(spark, view):
    fn = getattr(fixtures, view)
    assert (fn(spark, SF_SMALL).count(), fn(spark, SF_MID).count()) == COUNTS[view]


def test_attempt_sources(spark):
    assert fixtures.attempts(spark, SF_MID).select("source_id").distinct().count() == 150


def test_unseen_key_check_values(spark):
    keyed = content_key(fixtures.candidates(spark, SF_MID).where(F.col("l_orderkey") % 3 != 0), url_fallback=None)
    keys = keyed.select("content_hash").distinct()
    assert keys.count() == 26313
    assert only_unseen(keys, fixtures.known_jobs(spark, SF_MID)).count() == 16837


def test_gate_check_values(spark):
    g = robots_gate(fixtures.tracked(spark, SF_MID), robots_rules(fixtures.robots(spark, SF_MID)))
    r = g.agg(F.count_if(~F.col("robots_allowed")).alias("blocked"),
              F.count_if(F.col("robots_allowed") & (F.col("allow_len") >= 0)).alias("by_allow"),
              F.count_if((F.col("allow_len") < 0) & (F.col("disallow_len") < 0)).alias("unmatched")).first()
    assert (r.blocked, r.by_allow, r.unmatched) == (62, 6, 182)

"""All registered queries (importing the query modules fills the registry).

Order matters: later modules reuse oracle views defined by earlier ones.
"""

from __future__ import annotations

from jobtrail.plans import q_extract  # noqa: F401  isort: skip
from jobtrail.plans import q_sources  # noqa: F401  isort: skip
from jobtrail.plans import q_search  # noqa: F401  isort: skip
from jobtrail.plans import q_cycle  # noqa: F401  isort: skip
from jobtrail.plans import q_history  # noqa: F401  isort: skip
from jobtrail.plans import q_streams  # noqa: F401  isort: skip
from jobtrail.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}

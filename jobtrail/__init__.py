"""jobtrail: a Spark-native pipeline for tracking job postings.

Pages, robots files and model replies arrive as tables; every step from
HTML cleaning to keep-first dedupe, cycle bookkeeping, digests and search
is a DataFrame transformation (see README.md).
"""

__version__ = "0.1.0"

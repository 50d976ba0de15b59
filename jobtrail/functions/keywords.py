"""Keyword tagging (X1): case-insensitive substring match over a fixed list."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtrail.functions.text import first_items

# The technology keywords, in match (and output) order.
TECH_KEYWORDS = [
    "python", "javascript", "typescript", "react", "node.js", "next.js",
    "postgresql", "mysql", "mongodb", "redis", "docker", "kubernetes",
    "aws", "gcp", "azure", "terraform", "graphql", "rest api",
    "java", "go", "rust", "c++", "c#", ".net",
]
MAX_TAGS = 12


def display_form(keyword: str) -> str:
    """Upper-case the first ASCII letter of every word (``\\b\\w`` rule)."""
    return re.sub(r"\b\w", lambda m: m.group(0).upper(), keyword, flags=re.ASCII)


def tag_text(text: Column, keywords=None, limit: int | None = MAX_TAGS) -> Column:
    """Display forms of the keywords contained in ``text`` (already lower-cased), list order, first ``limit`` (None: all).

    One flat ``contains`` test per keyword, outside any lambda: Catalyst evaluates
    the lower-cased text once per row (a lambda would re-evaluate it per keyword).
    """
    kws = TECH_KEYWORDS if keywords is None else keywords
    hits = F.array(*[F.when(F.contains(text, F.lit(k.lower())), F.lit(display_form(k))) for k in kws])
    return first_items(F.filter(hits, lambda x: x.isNotNull()), limit)

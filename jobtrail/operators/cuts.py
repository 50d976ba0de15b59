"""Where a cycle cuts texts and lists. ``None`` turns a cut off; ``WHOLE`` turns all of them off."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cuts:
    #: Characters of a page's text, of the stored raw text, of a summary, of a fallback summary.
    page: int | None = 14000
    raw_text: int | None = 14000
    summary: int | None = 1200
    fallback: int | None = 550
    #: Postings of a page, entries of a stack, tags of a text.
    postings: int | None = 20
    stack: int | None = 20
    tags: int | None = 12


WHOLE = Cuts(None, None, None, None, None, None, None)

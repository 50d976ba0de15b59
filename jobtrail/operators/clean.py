"""M1: HTML page -> clean text.

Semantics: the nine elements below are removed with their content; the text
nodes of ``<body>`` are concatenated without separators (entities decoded, also
legacy ones without ``;``); when the body has no text at all, the text of the
whole document is used; JS-style whitespace runs collapse to one space; the
result is cut to ``max_chars`` code points (``None``: not cut).

An element ends with its end tag or when an ancestor ends, so a page that never
closes a ``<nav>`` or ``<form>`` loses that element only, not the rest of the page.
Which end tags may close what follows the HTML standard's scopes: a block's end
tag closes what is open inside it, but not through a table cell; an inline end tag
never closes a block; ``</form>`` ends the form but not the elements open in it. Text inside a
table but in no cell or caption stands before the table.

Only this step runs in Python: a stdlib ``html.parser`` tokenizer inside an
``arrow_udf`` that hands the texts on slice by slice. Nested removed elements and unclosed tags need a
tokenizer with a stack of open elements, which regular expressions cannot express.
"""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_CHARS = 14000
#: Pages cleaned at once: beside the Arrow batch that Spark sends, a worker holds the strings of so many.
SLICE_ROWS = 64

# Elements removed together with everything inside them.
REMOVED_ELEMENTS = frozenset(("script", "style", "noscript", "nav", "footer", "header", "svg", "iframe", "form"))
# Elements that may appear before <body> without opening it.
_PRE_BODY = frozenset(("html", "head", "title", "meta", "link", "base", "style", "script", "noscript",
                       "template", "basefont", "bgsound"))
# Fixed values of the HTML standard: elements without content, elements that bound a
# scope, parts of tables, other elements that inline end tags do not close, and
# elements that end an open <svg>.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SCOPE_ENDS = frozenset("applet caption html table td th marquee object template".split())
_TABLE_PARTS = frozenset("table caption colgroup tbody tfoot thead tr td th".split())
_BLOCKS = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe li listing main menu nav
    noembed noframes noscript ol p plaintext pre script search section select style summary textarea title ul xmp""".split())
_SPECIAL = _BLOCKS | _TABLE_PARTS | _SCOPE_ENDS
_SVG_BREAKERS = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img
    li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
# A start tag on the left ends an open element on the right within the same table.
_CELL_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"),
              "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
# What text belongs to inside a table: a cell, a caption, or else the table itself.
_TABLE_HOLDERS = ("td", "th", "caption", "table", "template")
_HTML_WS = " \t\n\f\r"
# Fixed value: the ECMAScript `\s` set (same as functions.text.JS_WS_CLASS).
_JS_WS_RUN = re.compile("[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


class _PageText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open elements: (tag, whether its text is removed)
        self.stack: list[tuple[str, bool]] = []
        # for each open table: how much of the body's text stands before it
        self.before: list[int] = []
        self.in_body = False
        self.in_title = False
        self.head: list[str] = []
        self.body: list[str] = []

    def parse_html_declaration(self, i):
        # a marked section in HTML is a comment up to the next ">"
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _find(self, tags, bounds) -> int:
        """Index of the innermost open element among ``tags`` that is not behind one of ``bounds``, else -1."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in bounds:
                return -1
        return -1

    def _pop_to(self, k: int) -> None:
        if k >= 0:
            del self.stack[k:]
            del self.before[sum(t == "table" for t, _ in self.stack):]

    def _add(self, data: str) -> None:
        """Text of the body; what a table cannot hold goes before it. Blanks stay where they are."""
        if self.before and data.strip(_HTML_WS) and self.stack[self._find(_TABLE_HOLDERS, ())][0] == "table":
            self.body.insert(self.before[-1], data)
            self.before[-1] += 1
        else:
            self.body.append(data)

    def handle_starttag(self, tag, attrs):
        if not self.in_body and (tag == "body" or tag not in _PRE_BODY):
            self.in_body = True
        if tag == "title":
            self.in_title = True
        if tag in _SVG_BREAKERS:
            self._pop_to(self._find(("svg",), _SPECIAL))
        if tag in _CELL_ENDS:
            self._pop_to(self._find(_CELL_ENDS[tag], ("table", "template")))
        elif tag in ("li", "dd", "dt"):
            self._pop_to(self._find(("li",) if tag == "li" else ("dd", "dt"), _SPECIAL - {"address", "div", "p"}))
        if tag in _VOID or tag == "form" and any(t == "form" for t, _ in self.stack) or tag in ("html", "body", "head"):
            return
        self.stack.append((tag, tag in REMOVED_ELEMENTS or bool(self.stack) and self.stack[-1][1]))
        if tag == "table":
            self.before.append(len(self.body))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # the self-closing flag only counts on foreign elements
        if tag == "svg" or any(t == "svg" for t, _ in self.stack[:-1]):
            if self.stack and self.stack[-1][0] == tag:
                self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "form":
            k = self._find(("form",), _SCOPE_ENDS)
            if k >= 0:
                del self.stack[k]
        elif tag in _TABLE_PARTS:
            self._pop_to(self._find((tag,), ("table", "template")))
        elif tag in _BLOCKS:
            self._pop_to(self._find((tag,), _SCOPE_ENDS))
        else:
            self._pop_to(self._find((tag,), _SPECIAL))

    def handle_data(self, data):
        if self.stack and self.stack[-1][1]:
            return
        if self.in_body:
            self._add(data)
        elif self.in_title or not data.strip(_HTML_WS):
            self.head.append(data)
        else:  # text outside the head elements opens the body
            self.in_body = True
            self.body.append(data)


def page_text(html: str | None, max_chars: int | None = MAX_PAGE_CHARS) -> str | None:
    """Clean text of one page (a small per-row helper for the UDF and for tests)."""
    if html is None:
        return None
    p = _PageText()
    p.feed(html)
    p.close()
    body = "".join(p.body)
    text = body if body else "".join(p.head)
    return _JS_WS_RUN.sub(" ", text).strip(" ")[:max_chars]


# Ship this module's code to the Python workers by value, so they need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _release() -> None:
    """Give freed memory back to the system: Spark keeps a worker for later tasks, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _texts(batches: Iterator[pa.Array], max_chars: int | None) -> Iterator[pa.Array]:
    """Clean texts of batches of pages, in slices: no batch is held as Python strings, nor are all its texts."""
    try:
        for b in batches:
            for lo in range(0, len(b), SLICE_ROWS):
                yield pa.array([page_text(h.as_py(), max_chars) for h in b.slice(lo, SLICE_ROWS)], pa.string())
            b = None  # before the next one is read
            _release()
    finally:
        _release()


def html_text(html: Column | str, max_chars: int | None = MAX_PAGE_CHARS) -> Column:
    """Column expression: clean text of an HTML column."""

    @F.arrow_udf("string")
    def _clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _texts(batches, max_chars)

    return _clean(F.col(html) if isinstance(html, str) else html)


def clean_pages(snaps: DataFrame, html_col: str = "html", out_col: str = "page_text",
                max_chars: int | None = MAX_PAGE_CHARS, keep_html: bool = False) -> DataFrame:
    """Add the clean text of every page; the (wide) HTML column is dropped unless asked for."""
    out = snaps.withColumn(out_col, html_text(html_col, max_chars))
    return out if keep_html else out.drop(html_col)

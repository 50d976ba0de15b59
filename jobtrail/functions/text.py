"""String helpers with JavaScript string semantics, built from Spark SQL functions.

Spark's ``\\s`` and ``trim`` are narrower than JavaScript's ``\\s`` and
``String.prototype.trim``; the explicit class below is the JS set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ECMAScript WhiteSpace + LineTerminator set matched by `\s`.
JS_WS_CLASS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the optimizer copies the whole expression
    (into a pushed-down filter): a chain of projections would grow exponentially there."""
    return F.transform(F.array(value), body)[0]


def collapse_ws(col: Column | str) -> Column:
    """``s.replace(/\\s+/g, " ").trim()``: runs of JS whitespace -> one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), JS_WS_CLASS + "+", " "))


def trim_js(col: Column | str) -> Column:
    """``s.trim()`` with the JS whitespace set (inner whitespace untouched)."""
    return F.regexp_replace(_c(col), f"^{JS_WS_CLASS}+|{JS_WS_CLASS}+$", "")


def null_if_blank(col: Column | str) -> Column:
    """Trimmed text, or NULL when nothing is left (optional label / salary)."""
    return F.nullif(trim_js(col), F.lit(""))


def cut(col: Column | str, n: int | None) -> Column:
    """First ``n`` characters (code points); None: not cut."""
    return _c(col) if n is None else F.substring(_c(col), 1, n)


def first_items(col: Column | str, n: int | None) -> Column:
    """First ``n`` elements of an array; None: all."""
    return _c(col) if n is None else F.slice(_c(col), 1, n)


def capitalize_words(col: Column | str) -> Column:
    """Upper-case every ASCII letter that starts a word (JS ``replace(/\\b\\w/g, toUpperCase)``).

    The string is cut before every non-word character; a piece that begins with
    ``[a-z]`` begins a word, so its first letter is upper-cased.
    """
    pieces = F.split(_c(col), "(?<=[^A-Za-z0-9_])")
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p),
        ),
        "",
    )


def html_escape(col: Column | str) -> Column:
    """Five-character HTML escaping, ``&`` first."""
    c = _c(col)
    for src, dst in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def leading_int(col: Column | str) -> Column:
    """``Number.parseInt(s, 10)``: the leading (signed) integer of a string, else NULL."""
    digits = F.regexp_extract(_c(col), r"^" + JS_WS_CLASS + r"*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("long"))


def ts_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from a naive (UTC) ``datetime``, independent of any time zone setting."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

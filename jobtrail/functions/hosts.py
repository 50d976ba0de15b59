"""Host names with letters outside ASCII, as browsers write them: mapped, then each label in Punycode.

The mapping follows the non-transitional rules of the URL standard: compatibility and case folding with
normalization, the ideographic full stops as dots, ignorable characters gone; sharp s, final sigma and the two joiners
stay letters of their own. Only rows with such a host reach the Arrow function; all others are NULL to it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that stay as they are (sharp s, final sigma, the joiners), those that vanish (soft hyphen,
# zero-width space, word joiner, byte order mark, grapheme joiner, Mongolian selectors), those that are dots.
_STAY = "\u00df\u03c2\u200c\u200d"
_VANISH = "\u00ad\u200b\u2060\ufeff\u034f\u180b\u180c\u180d\u180e"
_DOTS = "\u3002\uff0e\uff61"
_CAPITAL_SHARP_S = "\u1e9e"

#: An absolute URL whose authority holds a character outside ASCII.
_FOREIGN = r"^[^A-Za-z]*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/\\?#]*[^\x00-\x7f]"
_PARTS = r"(?s)^([^A-Za-z]*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#]*@)?)([^/\\?#:]*)(.*)$"


def mapped(host: str) -> str:
    """The mapping step: every character to its folded, normalized form."""
    out = []
    for c in unicodedata.normalize("NFC", host):
        if c in _DOTS:
            out.append(".")
        elif c == _CAPITAL_SHARP_S:
            out.append(_STAY[0])
        elif c not in _VANISH:
            out.append("".join(x if x in _STAY else x.casefold() for x in unicodedata.normalize("NFKC", c)))
    return unicodedata.normalize("NFC", "".join(out))


def ascii_host(host: str | None) -> str | None:
    """``host`` with every foreign label as ``xn--`` and its Punycode."""
    if host is None:
        return None
    labels = mapped(host).split(".")
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in labels)


def with_ascii_hosts(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out`` = the URL of ``col`` with a foreign host name in ASCII form; all else as it is."""

    @F.pandas_udf("string")
    def hosts(names: pd.Series) -> pd.Series:
        return names.map(ascii_host, na_action="ignore")

    url = F.col(col)
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    named = df.withColumn("_host", hosts(F.when(url.rlike(_FOREIGN), part(2))))
    return named.withColumn(out, F.when(F.col("_host").isNull(), url).otherwise(F.concat(part(1), F.col("_host"), part(3)))).drop("_host")

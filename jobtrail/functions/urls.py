"""URL parsing and canonicalization as Column expressions (no Python UDF).

``canonical_url`` follows the WHATWG URL serializer for the special schemes
(http, https, ws, wss, ftp): scheme and host lower-cased, default port dropped,
empty path -> ``/``, ``.``/``..`` segments resolved, a small set of characters
and all non-ASCII ones percent-encoded, query and fragment kept (``with_canonical_url`` also
maps a non-ASCII host to its ASCII form, the expression alone only lower-cases it).  Other schemes are passed through with
a lower-cased scheme.  A string that is not an absolute URL gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.hosts import with_ascii_hosts
from jobtrail.functions.text import let, trim_js

# The special schemes and their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _encode(col: Column, pairs) -> Column:
    """Percent-encode the characters of ``pairs`` and the UTF-8 bytes of every non-ASCII one."""
    for src, dst in pairs:
        col = F.replace(col, F.lit(src), F.lit(dst))
    other = r"[^\x00-\x7f]"
    chars = lambda x: F.transform(F.split(x, ""), lambda c: F.when(
        c.rlike(other), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return let(col, lambda x: F.when(x.rlike(other), F.array_join(chars(x), "")).otherwise(x))


_PATH_ENC = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D"))
_QUERY_ENC = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27"))
_FRAG_ENC = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a trailing one leaves a trailing slash."""
    segs = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.size(segs) - 1
    indexed = F.transform(segs, lambda s, i: F.struct(F.lower(s).alias("s"), s.alias("raw"), i.alias("i")))
    empty = F.array().cast("array<string>")

    def step(acc, e):
        dotdot = e["s"].isin("..", ".%2e", "%2e.", "%2e%2e")
        dot = e["s"].isin(".", "%2e")
        tail = F.when(e["i"] == last, F.array(F.lit(""))).otherwise(empty)
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return (F.when(dotdot, F.concat(popped, tail))
                .when(dot, F.concat(acc, tail))
                .otherwise(F.concat(acc, F.array(e["raw"]))))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(indexed, empty, step), "/"))


def _steps(col: Column):
    """Named intermediate expressions of the serializer, in dependency order."""
    return [
        ("s", F.regexp_replace(F.regexp_replace(trim_js(col), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")),
        ("raw_scheme", lambda c: F.regexp_extract(c("s"), _SCHEME_RE, 1)),
        ("rest", lambda c: F.regexp_extract(c("s"), r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$", 1)),
        # backslashes count as slashes in the authority and the path, not behind ? or #
        ("head", lambda c: F.regexp_extract(c("rest"), r"^([^?#]*)", 1)),
        ("r", lambda c: F.concat(F.regexp_replace(F.replace(c("head"), F.lit("\\"), F.lit("/")), "^/*", ""),
                                 F.substring(c("rest"), F.length(c("head")) + 1, 1 << 30))),
        ("authority", lambda c: F.regexp_extract(c("r"), r"^([^/?#]*)", 1)),
        ("tail", lambda c: F.substring(c("r"), F.length(c("authority")) + 1, 1 << 30)),
        ("hostport", lambda c: F.regexp_extract(c("authority"), r"([^@]*)$", 1)),
        ("parts", lambda c: F.struct(
            F.lower(c("raw_scheme")).alias("scheme"),
            F.regexp_extract(c("authority"), r"^(.*)@", 1).alias("userinfo"),
            F.lower(F.regexp_extract(c("hostport"), r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
            F.regexp_extract(c("hostport"), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port"),
            F.regexp_extract(c("tail"), r"^([^?#]*)", 1).alias("path"),
            F.regexp_extract(c("tail"), r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(c("tail"), r"(?s)(#.*)$", 1).alias("fragment"))),
    ]


def _serialize(raw_scheme: Column, rest: Column, p: Column) -> Column:
    scheme, host, port, path = p["scheme"], p["host"], p["port"], p["path"]
    special = scheme.isin(*DEFAULT_PORTS)
    port_num = F.when(port.rlike("^[0-9]{1,5}$"), port.cast("int"))
    default_port = F.create_map(*[x for k, v in DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])[scheme]
    port_ok = (port == "") | (port_num.isNotNull() & (port_num <= 65535))
    host_ok = (host != "") & (host.rlike(r"^\[[0-9a-f:.]+\]$") | ~host.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|]"))
    port_out = F.when((port == "") | (port_num == default_port), F.lit("")).otherwise(
        F.concat(F.lit(":"), port_num.cast("string")))
    has_dots = path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)")
    path_out = F.when(path == "", F.lit("/")).when(has_dots, _resolve_dots(path)).otherwise(path)
    special_url = F.concat(
        scheme, F.lit("://"),
        F.when(p["userinfo"] != "", F.concat(p["userinfo"], F.lit("@"))).otherwise(F.lit("")),
        host, port_out,
        _encode(path_out, _PATH_ENC), _encode(p["query"], _QUERY_ENC), _encode(p["fragment"], _FRAG_ENC),
    )
    return (F.when(raw_scheme == "", F.lit(None).cast("string"))
            .when(special & host_ok & port_ok, special_url)
            .when(special, F.lit(None).cast("string"))
            .otherwise(F.concat(scheme, F.lit(":"), rest)))


def canonical_url(col: Column | str) -> Column:
    """Canonical URL as one expression in which every intermediate string is computed once per row."""

    def chain(env: dict[str, Column], steps: list) -> Column:
        if not steps:
            return _serialize(env["raw_scheme"], env["rest"], env["parts"])
        (name, f), left = steps[0], steps[1:]
        return let(f if isinstance(f, Column) else f(env.__getitem__), lambda x: chain({**env, name: x}, left))

    return chain({}, _steps(_c(col)))


def with_canonical_url(df: DataFrame, col: str, out: str = "canonical_url") -> DataFrame:
    """Add ``out`` = canonical URL of ``col``, host names outside ASCII in their ASCII form."""
    return with_ascii_hosts(df, col, "_ascii_url").withColumn(out, canonical_url("_ascii_url")).drop("_ascii_url")


def is_absolute_url(col: Column | str) -> Column:
    return canonical_url(col).isNotNull()


_AUTH = r"^([a-z][a-z0-9+.\-]*://)(?:[^/?#@]*@)?([^/?#]*)"


def url_origin(col: Column | str) -> Column:
    """``scheme://host[:port]`` of a canonical URL (no userinfo)."""
    c = _c(col)
    return F.concat(F.regexp_extract(c, _AUTH, 1), F.regexp_extract(c, _AUTH, 2))


def url_host(col: Column | str) -> Column:
    """Host of a canonical URL, without port."""
    return F.regexp_extract(F.regexp_extract(_c(col), _AUTH, 2), r"^(\[[^\]]*\]|[^:]*)", 1)


def url_path(col: Column | str) -> Column:
    """Path of a canonical URL (``/`` at least), without query and fragment."""
    p = F.regexp_extract(_c(col), r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)

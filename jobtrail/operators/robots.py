"""Robots policy: rule rows per origin (R1) and the allow/deny gate per URL.

R1 explodes each robots body into numbered lines; whether a line belongs to the
``*`` group is the value of the most recent ``user-agent`` line, carried forward
with a window over one origin's lines (bounded by one file, never by the data).
R2 gathers each origin's rules into one array row, joins it to the URLs on the
origin (AQE picks the join by bytes and splits a hot origin), and takes the
longest matching prefixes in one pass over the array: no per-URL regrouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.text import trim_js
from jobtrail.functions.urls import url_origin, url_path, with_canonical_url

# Fixed value: failure text when robots.txt forbids the path.
ROBOTS_REASON = "Scrape skipped because robots.txt disallows this path for user-agent '*'"


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, line_no, kind, prefix) of the allow/disallow rules that apply to agent ``*``.

    Only the latest body of an origin counts (``max_by``, combined map-side; ties by the body), and only
    if its status is 2xx: any other status or a missing body means "no rules". Origins are
    canonicalized like URLs. Empty rules are dropped (they never match).
    """
    latest = (with_canonical_url(robots, "origin", "_url").withColumn("origin", url_origin(F.col("_url")))
              .groupBy("origin").agg(F.max_by(F.struct("http_status", "body"), F.struct("fetched_at", "body")).alias("r")).select("origin", "r.*"))
    ok = latest.where(F.col("http_status").between(200, 299) & F.col("body").isNotNull())
    lines = ok.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "raw"))
    line = trim_js(F.substring_index(F.col("raw"), "#", 1))
    colon = F.instr(line, ":")
    parsed = lines.select(
        "origin", "line_no",
        F.when((colon > 1), F.lower(trim_js(F.substring_index(line, ":", 1)))).alias("key"),
        trim_js(F.substring(line, colon + 1, 1 << 30)).alias("value"),
    ).where(F.col("key").isNotNull() & (F.col("key") != ""))
    w = Window.partitionBy("origin").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.last(F.when(F.col("key") == "user-agent", F.col("value") == "*"), ignorenulls=True).over(w)
    return (parsed.withColumn("active", F.coalesce(active, F.lit(False)))
                  .where(F.col("active") & F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
                  .select("origin", "line_no", F.col("key").alias("kind"), F.col("value").alias("prefix")))


def rules_by_origin(rules: DataFrame) -> DataFrame:
    """One row per origin with its distinct rules as an array (at most the size of its robots file; the
    gate only takes maxima, so order does not matter)."""
    return rules.groupBy("origin").agg(F.collect_set(F.struct("kind", "prefix")).alias("rules"))


def robots_gate(urls: DataFrame, rules: DataFrame, url_col: str = "url", canon_col: str | None = None) -> DataFrame:
    """Add ``allow_len``, ``disallow_len`` and ``robots_allowed`` to every URL row.

    Allowed iff no disallow rule matches or the longest allow >= the longest disallow;
    an origin without rules (no file, non-2xx, error) allows everything.
    """
    if canon_col is None:
        urls, canon_col = with_canonical_url(urls, url_col, "_canon"), "_canon"
    canon = F.col(canon_col)
    u = urls.withColumn("_origin", url_origin(canon)).withColumn("_path", url_path(canon))
    ro = rules_by_origin(rules).withColumnRenamed("origin", "_origin")
    none = F.struct(F.lit(-1).alias("allow"), F.lit(-1).alias("disallow"))

    def longer(best, r):  # both maxima in one pass over the rules
        n = F.when(F.startswith(F.col("_path"), r["prefix"]), F.length(r["prefix"])).otherwise(F.lit(-1))
        side = lambda kind: F.greatest(best[kind], F.when(r["kind"] == kind, n).otherwise(F.lit(-1))).alias(kind)
        return F.struct(side("allow"), side("disallow"))

    j = u.join(ro, "_origin", "left").withColumn("_best", F.coalesce(F.aggregate("rules", none, longer), none))
    j = j.withColumn("allow_len", F.col("_best.allow")).withColumn("disallow_len", F.col("_best.disallow"))
    return j.withColumn("robots_allowed", (F.col("disallow_len") == -1) | (F.col("allow_len") >= F.col("disallow_len"))) \
            .drop("_origin", "_path", "rules", "_best", "_canon")


def robots_gate_indexed(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """``robots_gate`` for origins with very many rules: each path is looked up by its own beginnings.

    A path is cut to the lengths that prefixes of its origin have, and these beginnings meet the rules in an equality
    join; a URL costs as many look-ups as there are lengths, however many rules the origin has. ``id_col`` names the
    rows. The lengths of an origin are a set bounded by its longest prefix.
    """
    canon = with_canonical_url(urls, url_col, "_canon")
    paths = canon.select(F.col(id_col).alias("_id"), url_origin(F.col("_canon")).alias("origin"), url_path(F.col("_canon")).alias("_path"))
    distinct = rules.select("origin", "kind", "prefix").distinct()
    lengths = distinct.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    begun = paths.join(lengths, "origin").select("_id", "origin", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"))
    probes = begun.select("_id", "origin", "_n", F.expr("substring(_path, 1, _n)").alias("prefix"))
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_n")))
    found = probes.join(distinct, ["origin", "prefix"]).groupBy("_id").agg(longest("allow").alias("allow_len"), longest("disallow").alias("disallow_len"))
    out = urls.join(found, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumns(
        {c: F.coalesce(c, F.lit(-1)) for c in ("allow_len", "disallow_len")})
    return out.withColumn("robots_allowed", (F.col("disallow_len") == -1) | (F.col("allow_len") >= F.col("disallow_len")))

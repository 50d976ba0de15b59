"""URL filter: rules by host suffix and path prefix, and link-graph propagation for the rest.

Hosts are nodes. Edges: hyperlinks between hosts, and each host with the domain right above it, both ways (a
site's hosts vouch for one another). Trust starts at hosts whose pages an allow rule fits and follows
edges (personalised PageRank); distrust starts at hosts with pages under a block rule and follows
edges backwards. A host is blocked when its distrust is above ``MARGIN`` times its trust and
above its even share of all distrust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.tables import keep

DAMPING = 0.85
ROUNDS = 8
MARGIN = 2.0
#: Most rules; they are part of the expression, not a table.
MAX_RULES = 1000

Rule = tuple[str, str, str]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: then up to ``?``, ``#`` or the
    end. Both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``(rule, verdict)`` of the longest ``(verdict, host, path)`` rule that fits, else null. A rule
    fits its host and all subdomains where the path starts with the rule's."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def host_edges(located: DataFrame) -> DataFrame:
    """``(host, html)`` -> ``(src, dst, weight)``: hyperlinks to other hosts, counted, and domain edges of weight 1."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), 1)))
    links = located.filter("host <> ''").select(F.col("host").alias("src"), target.alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = located.filter("host <> ''").select("host").distinct()
    above = F.regexp_extract("host", r"^[^.]*\.(.+\..+)$", 1)
    up = hosts.select("host", above.alias("up")).filter("up <> ''")
    both = up.select(F.col("host").alias("src"), F.col("up").alias("dst")).union(up.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    return links.unionByName(both.withColumn("weight", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``edges (src, dst, weight)`` and ``seeds (host, trust, distrust)`` -> ``(host, trust, distrust)``.

    Both seed columns are scaled to sum to 1. What a host without onward edges holds is not passed on.
    """
    totals = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    share = lambda c, total: (F.col(c) / F.lit(float(total))) if total else F.lit(0.0)
    start = keep(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), share("trust", totals.t).alias("score")), F.struct(F.lit(1).alias("kind"), share("distrust", totals.d).alias("score")))).alias("s"))
                 .select("host", "s.kind", "s.score").filter("score > 0"), "seeds")
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight"))
    out = ways.groupBy("kind", "host").agg(F.sum("weight").alias("all"))
    ways = keep(ways.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("all")).alias("part")), "edges")
    rank = start
    for _ in range(rounds):
        passed = ways.join(rank, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        rank = keep(passed.unionByName(start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score")), "rank")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return rank.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, host, path, rule, verdict)``, one row for each row.

    A null url or one without ``://`` has an empty host, which no rule fits and no edge reaches: allowed.
    Null html has no links. Null ids and repeated rows come out as they came in (repeated pages count as
    often for the seeds). An empty table gives an empty table; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = keep(located.select("page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("fit")).select("page_id", "host", "path", "fit.rule", "fit.verdict"), "ruled")
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    scores = propagate(host_edges(located), seeds)
    # what leaves the graph at hosts without onward edges is gone: the share is of what is left
    even = (scores.agg(F.sum("distrust")).first()[0] or 0.0) / max(1, seeds.count())
    blocked = scores.filter((F.col("distrust") > MARGIN * F.col("trust")) & (F.col("distrust") > even)).select("host", F.lit("block").alias("spread"))
    open_ = ruled.filter("verdict is null").join(blocked, "host", "left")
    return ruled.filter("verdict is not null").select("page_id", "host", "path", "rule", "verdict").unionByName(
        open_.select("page_id", "host", "path", "rule", F.coalesce("spread", F.lit("allow")).alias("verdict")))


def judge_sql(rules: list[Rule], table: str = "pages") -> str:
    """The same rows in DuckDB SQL, with the rounds written out."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    steps = "".join(f""",
r{i + 1} AS (SELECT kind, host, sum(score) AS score FROM (
    SELECT w.kind, w.to_ AS host, r.score * w.part * {DAMPING} AS score FROM ways w JOIN r{i} r ON w.kind = r.kind AND w.host = r.host
    UNION ALL SELECT kind, host, score * (1 - {DAMPING}) FROM r0) GROUP BY ALL)""" for i in range(ROUNDS))
    return rf"""
WITH rest AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
parted AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
located AS (SELECT page_id, html, {lower('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parted),
ruled AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM located),
found AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1))) AS raw FROM located WHERE host <> ''),
links AS (SELECT src, {lower('raw')} AS dst, count(*) AS weight FROM found WHERE src <> {lower('raw')} GROUP BY ALL),
up AS (SELECT DISTINCT host, regexp_extract(host, '^[^.]*\.(.+\..+)$', 1) AS up FROM located WHERE host <> ''),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT host, up, 1 FROM up WHERE up <> '' UNION ALL SELECT up, host, 1 FROM up WHERE up <> '') GROUP BY ALL),
both_ways AS (SELECT 0 AS kind, src AS host, dst AS to_, weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
ways AS (SELECT kind, host, to_, weight / sum(weight) OVER (PARTITION BY kind, host) AS part FROM both_ways),
seeds AS (SELECT host, count(*) FILTER (verdict = 'allow') AS trust, count(*) FILTER (verdict = 'block') AS distrust FROM ruled WHERE host <> '' GROUP BY host),
r0 AS (SELECT 0 AS kind, host, trust / (SELECT sum(trust) FROM seeds) AS score FROM seeds WHERE trust > 0
    UNION ALL SELECT 1, host, distrust / (SELECT sum(distrust) FROM seeds) FROM seeds WHERE distrust > 0){steps},
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS trust, coalesce(sum(score) FILTER (kind = 1), 0) AS distrust FROM r{ROUNDS} GROUP BY host),
blocked AS (SELECT host FROM scores WHERE distrust > {MARGIN} * trust AND distrust > (SELECT sum(distrust) FROM scores) / (SELECT greatest(1, count(*)) FROM seeds))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""

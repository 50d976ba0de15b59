import re

from jobtrail.llm import queries, urlfilter
from jobtrail.llm.tables import read
from tests.llm.helpers import SF


def plain(pages):
    """Rules, edges and rounds in dictionaries."""
    located, edges, hosts = [], {}, set()
    for page_id, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        located.append((page_id, host, path, rule, verdict))
        if host:
            hosts.add(host)
            for t in {x for x in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "")}:
                t = t.lower()
                if t != host:
                    edges[host, t] = edges.get((host, t), 0) + 1
    for h in hosts:
        up = h.partition(".")[2]
        if "." in up and not up.startswith(".") and not up.endswith("."):
            for e in ((h, up), (up, h)):
                edges[e] = edges.get(e, 0) + 1
    scores = []
    for kind, verdict in enumerate(("allow", "block")):
        way = edges if not kind else {(b, a): w for (a, b), w in edges.items()}
        out = {}
        for (a, _), w in way.items():
            out[a] = out.get(a, 0) + w
        seeds = {}
        for _, h, _, _, v in located:
            if h and v == verdict:
                seeds[h] = seeds.get(h, 0) + 1
        total = sum(seeds.values())
        start = {h: n / total for h, n in seeds.items()}
        rank = dict(start)
        for _ in range(urlfilter.ROUNDS):
            new = {h: (1 - urlfilter.DAMPING) * s for h, s in start.items()}
            for (a, b), w in way.items():
                if a in rank:
                    new[b] = new.get(b, 0) + rank[a] * w / out[a] * urlfilter.DAMPING
            rank = new
        scores.append(rank)
    trust, distrust = scores
    bad = {h for h, d in distrust.items() if d > urlfilter.MARGIN * trust.get(h, 0) and d > sum(distrust.values()) / max(1, len(hosts))}
    return sorted(((p, h, path, r, v or ("block" if h in bad else "allow")) for p, h, path, r, v in located), key=str)


def judged(spark, data):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in data], "page_id long, url string, html string, host string, rule int")
    return sorted((tuple(r) for r in urlfilter.judge(pages, queries.URL_RULES).collect()), key=str)


def test_pages(spark):
    data = [tuple(r) for r in read(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = judged(spark, data)
    assert got == plain(data)
    assert {r[4] for r in got} == {"allow", "block"}


def test_links_and_edges(spark):
    spam = "".join(f'<a href="http://Bad.net/es/{i}">' for i in range(5))
    data = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/fr/1", ""), (3, "http://bad.net/x", ""), (4, "http://farm.org/", spam), (5, "http://clean.org/", '<a href="https://Good.com/">'),
            (6, "http://good.com/", '<a href=//clean.org/x>'), (7, None, spam), (8, "no scheme", None), (9, "http://", ""), (10, "x://EXAMPLE.com/en/a?b#c", None), (11, "http://www.example.com/en/", None),
            (12, "http://example.com?q=/en/", None), (13, "http://example.com/enx", None), (14, "http://a.net/es", None), (None, "http://notnet/es/", None), (4, "http://farm.org/", spam), (15, "http://x.com/a://b/en/", "y" * 100_000)]
    got = judged(spark, data)
    assert got == plain(data)
    by = {r[0]: r for r in got}
    assert by[3][4] == "block" and by[10][3:] == ("example.com/en/", "block") and by[11][3:] == ("www.example.com/en/", "allow") and by[12][3] is None and by[14][3] is None
    assert by[5][4] == "allow" and by[7][1:] == ("", "", None, "allow")
    assert judged(spark, []) == []

"""R1, R2/J4, plus a property test against a plain restatement of the rule."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from jobtrail.operators.robots import robots_gate, robots_rules

NOW = datetime(2025, 1, 1)
ROBOTS = "origin string, http_status int, body string, fetched_at timestamp_ntz"


def gate(spark, body, path, status=200):
    r = spark.createDataFrame([("https://A.example:443", status, body, NOW)], ROBOTS)
    u = spark.createDataFrame([("1", "https://a.example" + path)], "id string, url string")
    return robots_gate(u, robots_rules(r)).first().robots_allowed


def test_edge_rows(spark):
    assert gate(spark, "User-agent: *\nDisallow: /es\nAllow: /es", "/es/1") is True
    assert gate(spark, "User-agent: *\nUser-agent: x\nDisallow: /", "/a") is True
    assert gate(spark, "User-agent: *\nDisallow: /", "/a") is False
    assert gate(spark, "User-agent: *\nDisallow: /", "/a", status=404) is True
    assert gate(spark, "# none\nuser-agent: *\nDisallow:", "/a") is True
    assert gate(spark, "User-agent: *\nDisallow: /en\nAllow: /en/4 # ok", "/en/45") is True
    assert gate(spark, "User-agent: *\nDisallow: /en\nAllow: /en/4 # ok", "/en/5") is False
    assert gate(spark, "User-agent: *\r\nDisallow: /a?x", "/a?x=1") is True  # query is not part of the path


def test_missing_origin_allows(spark):
    r = spark.createDataFrame([("https://other.example", 200, "User-agent: *\nDisallow: /", NOW)], ROBOTS)
    u = spark.createDataFrame([("1", "https://a.example/x")], "id string, url string")
    assert robots_gate(u, robots_rules(r)).first().robots_allowed is True


def plain(body, path):
    active, allow, disallow = False, [], []
    for raw in body.split("\n"):
        line = raw.split("#")[0].strip()
        if not line or ":" not in line or line.startswith(":"):
            continue
        key, value = line.split(":", 1)[0].strip().lower(), line.split(":", 1)[1].strip()
        if key == "user-agent":
            active = value == "*"
        elif active and key in ("allow", "disallow"):
            (allow if key == "allow" else disallow).append(value)
    best = lambda rules: max([len(r) for r in rules if r and path.startswith(r)], default=-1)
    return best(disallow) == -1 or best(allow) >= best(disallow)


line = st.one_of(st.sampled_from(["User-agent: *", "User-agent: x", "# c", ""]),
                 st.builds(lambda k, v: f"{k}: {v}", st.sampled_from(["Allow", "Disallow", "allow", "disallow"]),
                           st.sampled_from(["", "/", "/a", "/ab", "/a/b", "/b"])))


@settings(max_examples=25, deadline=None)
@given(st.lists(line, max_size=6), st.sampled_from(["/", "/a", "/ab", "/a/b", "/b/c"]))
def test_matches_plain_restatement(spark, lines, path):
    body = "\n".join(lines)
    assert gate(spark, body, path) == plain(body, path)


def test_copies_and_versions_of_one_file(spark):
    old = NOW - timedelta(days=1)
    rows = [("https://a.example", 200, "User-agent: *\nDisallow: /x", NOW)] * 5 + [("https://a.example", 200, "User-agent: *\nDisallow: /", old)]
    r = spark.createDataFrame(rows, ROBOTS)
    rules = robots_rules(r).collect()
    assert [(x.kind, x.prefix) for x in rules] == [("disallow", "/x")]
    u = spark.createDataFrame([("1", "https://a.example/x1"), ("2", "https://a.example/y")], "id string, url string")
    assert {x.id: x.robots_allowed for x in robots_gate(u, robots_rules(r)).collect()} == {"1": False, "2": True}


def test_indexed_gate_equals_the_pass_over_rules(spark):
    import random

    from jobtrail.operators.robots import robots_gate, robots_gate_indexed

    rnd = random.Random(3)
    path = lambda: "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(0, 8)))
    rules = [("https://a.example", i, rnd.choice(["allow", "disallow"]), path()) for i in range(400)] + [("https://b.example", 1, "disallow", "/"), ("https://b.example", 2, "disallow", "/")]
    urls = [(i, f"https://{rnd.choice('abc')}.example{path()}?q") for i in range(300)] + [(900, None), (901, "no url"), (902, "https://a.example")]
    r = spark.createDataFrame(rules, "origin string, line_no int, kind string, prefix string")
    u = spark.createDataFrame(urls, "id int, url string")
    pick = lambda d: sorted((x.id, x.allow_len, x.disallow_len, x.robots_allowed) for x in d.collect())
    assert pick(robots_gate_indexed(u, r, "id")) == pick(robots_gate(u, r))

"""P2 canonical URLs, P3 source type, F9 URL parts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtrail.functions.urls import canonical_url, url_host, url_origin, url_path, with_canonical_url

CASES = {
    "HTTPS://WWW.Example.COM:443": "https://www.example.com/",
    "HTTPS://WWW.Example.COM:443/a/../b/3": "https://www.example.com/b/3",
    "  http://x.example/a/b/.. ": "http://x.example/a/",
    "http://x.example:8080/a/./b?q=1 2#f g": "http://x.example:8080/a/b?q=1%202#f%20g",
    "http://x.example/a b": "http://x.example/a%20b",
    "https://user:pw@Host.example/p": "https://user:pw@host.example/p",
    "not a url": None,
    "http://": None,
    "http://exa mple.com/": None,
    "http://x.example:99999/": None,
    "MAILTO:someone@example.com": "mailto:someone@example.com",
    "": None,
    None: None,
}


def test_canonical_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "u string")
    got = {r.u: r.c for r in df.select("u", canonical_url("u").alias("c")).collect()}
    assert got == CASES
    got2 = {r.u: r.canonical_url for r in with_canonical_url(df, "u").collect()}
    assert got2 == CASES


def test_parts(spark):
    df = spark.createDataFrame([("https://u@www.Acme.com:8443/x/y?q#f",)], "u string")
    r = df.select(canonical_url("u").alias("c")).select(url_origin("c").alias("o"), url_host("c").alias("h"),
                                                       url_path("c").alias("p")).first()
    assert (r.o, r.h, r.p) == ("https://www.acme.com:8443", "www.acme.com", "/x/y")


segment = st.text(alphabet="ab.", min_size=0, max_size=3)


@settings(max_examples=30, deadline=None)
@given(st.lists(segment, max_size=5), st.sampled_from(["http", "HTTPS"]), st.sampled_from(["", ":80", ":443", ":8080"]))
def test_idempotent(spark, segs, scheme, port):
    u = f"{scheme}://Host.Example{port}/" + "/".join(segs)
    df = spark.createDataFrame([(u,)], "u string")
    c1 = df.select(canonical_url("u").alias("c")).first().c
    c2 = spark.createDataFrame([(c1,)], "u string").select(canonical_url("u").alias("c")).first().c
    assert c1 == c2 and c1.startswith(scheme.lower() + "://host.example")

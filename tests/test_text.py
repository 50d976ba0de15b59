"""F1-F16 golden rows."""

from pyspark.sql import functions as F

from jobtrail.functions.text import capitalize_words, collapse_ws, html_escape, leading_int, null_if_blank, trim_js
from jobtrail.operators.search import clamp_limit, day_end, day_start


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col.alias("r")).first()["r"]


def test_whitespace_js_set(spark):
    assert one(spark, collapse_ws("v"), "a\u00a0b\ufeffc") == "a b c"
    assert one(spark, collapse_ws("v"), "  a \t\n\u2003 b\u3000") == "a b"
    assert one(spark, trim_js("v"), "\u00a0 a  b \ufeff") == "a  b"
    assert one(spark, null_if_blank("v"), " \u00a0 ") is None


def test_capitalize_word_starts(spark):
    assert one(spark, capitalize_words("v"), "my-co") == "My-Co"
    assert one(spark, capitalize_words("v"), "node.js") == "Node.Js"
    assert one(spark, capitalize_words("v"), "rest api") == "Rest Api"
    assert one(spark, capitalize_words("v"), "3com") == "3com"
    assert one(spark, capitalize_words("v"), ".net") == ".Net"


def test_html_escape_ampersand_first(spark):
    assert one(spark, html_escape("v"), "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


def test_leading_int(spark):
    assert one(spark, leading_int("v"), " 10abc") == 10
    assert one(spark, leading_int("v"), "x") is None


def test_limit_rule():
    assert [clamp_limit(x) for x in ["10abc", "0", "-3", "x", "5000", None, " 7"]] == [10, 500, 500, 500, 2000, 500, 7]


def test_day_bounds():
    assert str(day_start("2024-05-01")) == "2024-05-01 00:00:00"
    assert str(day_end("2024-05-01")) == "2024-05-01 23:59:59.999000"
    assert str(day_start("2024-05")) == "2024-05-01 00:00:00" and str(day_end("2024")) == "2024-01-01 23:59:59.999000"
    assert day_start("nope") is None and day_start("2024-5") is None and day_end("2024-02-30") is None

"""M1 edge rows."""

from jobtrail.operators.clean import clean_pages, page_text


def test_edge_rows():
    assert page_text("<p>a</p><p>b</p>") == "ab"
    assert page_text("<nav>x<nav>y</nav>z</nav>k") == "k"
    assert page_text("<p>a&ampB</p>") == "a&B"
    assert page_text("<html><head><title>T</title></head><body></body></html>") == "T"
    assert page_text("x" * 14001) == "x" * 14000
    assert page_text('<body><script>var t="</p>";</script>hi <b>there</b></body>') == "hi there"
    assert page_text("<body>a<footer>f") == "a"
    assert page_text("<title>T</title><div>x</div>") == "x"
    assert page_text("<body>a<form><input>q</form>b<header>h</header>c<svg><path/>s</svg>d</body>") == "abcd"
    assert page_text(None) is None


def test_unclosed_and_nested_elements_lose_only_themselves():
    assert page_text("<div><nav>menu</div><main>Senior Engineer at Acme</main>") == "Senior Engineer at Acme"
    assert page_text("<table><tr><td><form>q</td></tr></table><p>Jobs here</p>") == "Jobs here"
    assert page_text("<form>a<form>b</form>c</form>d") == "cd"
    assert page_text("<form><div>a</form>b</div>c") == "c"
    assert page_text("<b><nav>x</b>y</nav>z") == "z"
    assert page_text("<p>a</p><![foo[x]]><p>job text</p>") == "ajob text"
    assert page_text("<svg>a<p>b") == "b" and page_text("<svg><path/><circle>r</svg>ok<svg/>k") == "okk"
    assert page_text("<ul><li><nav>a<li>b</ul>c") == "c" and page_text("x<br><input>y", max_chars=None) == "xy"


def test_whitespace_only_body_is_not_empty():
    # body text "\n" is truthy: the result is "" and the title is not used
    assert page_text("<html><head><title>T</title></head><body>\n</body></html>") == ""


def test_udf_matches_helper(spark):
    html = ["<p>a</p><p>b</p>", "<nav>x</nav>k", None, "<html><body> a \u00a0 b </body></html>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    got = {r.page_id: r.page_text for r in clean_pages(df).collect()}
    assert got == {i: page_text(h) for i, h in enumerate(html)}


def test_text_that_a_table_cannot_hold():
    from jobtrail.operators.clean import page_text
    from jobtrail.plans.q_extract import TABLES, TABLES_TEXT

    for html, want in ((TABLES, TABLES_TEXT.strip()), ("a <table>b <tr><td>c </td></tr>d </table>e", "a b d c e"), ("<table><tr><td>x</td></tr></table>", "x"),
                       ("<table>  <tr> <td>x</td> </tr></table>y", "x y"), ("<table><tr><td>1 <table>2 <tr><td>3 </td>4 </tr></table></td></tr>5 </table>", "5 1 2 4 3"),
                       ("<nav><table>gone</table></nav>kept <table>t", "kept t"), ("<table><form>gone</form>t <tr><td>c", "t c"), ("<table></table>after", "after")):
        assert page_text("<body>" + html + "</body>").replace("  ", " ") == want, html


def test_pages_are_cleaned_in_slices(spark):
    import pyarrow as pa

    from jobtrail.operators.clean import SLICE_ROWS, _texts

    html = [None if i % 7 == 0 else f"<nav>m</nav><p>page {i} \u4e2d</p>" for i in range(3 * SLICE_ROWS + 5)]
    taken = []

    def batches():
        for part in (html[:SLICE_ROWS + 1], [], html[SLICE_ROWS + 1:]):
            taken.append(len(part))
            yield pa.array(part, pa.string())

    out = _texts(batches(), 8)
    first = next(out)
    assert len(first) <= SLICE_ROWS and len(taken) == 1  # the texts leave before the next batch is read
    parts = [first, *out]
    assert max(map(len, parts)) <= SLICE_ROWS and [t for a in parts for t in a.to_pylist()] == [page_text(h, 8) for h in html]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string").coalesce(1)
    assert {r.page_id: r.page_text for r in clean_pages(df).collect()} == {i: page_text(h) for i, h in enumerate(html)}

"""Fill-in-middle against a plain version; exact round trips; chunks follow the content."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import fim
from jobtrail.llm.tables import read
from tests.llm.helpers import SF


def plain(doc_id, text, seed=7, percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < spm_percent:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    rnd = random.Random(2)
    words = ["añb", "x", "語語", "😀", "word", "", " ", "<P", "S>", "<", "M>"]
    made = ["", "\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb c", "x<S>y", "<P>", "ab<M", "z" * 100_000, "z\n" * 40_000, "語" * 40_000 + "\n" + "é" * 50_000, "tail\x00\n\x00"]
    for size in (5, 60, 700, 9000):
        made += ["".join(rnd.choice(words) + rnd.choice(["\n", " ", "", "\t"]) for _ in range(size)) for _ in range(6)]
    return made


@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 0), (100, 100)])
def test_texts_of_all_kinds(spark, percent, spm):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a\nb\nc", None, 2), (500, None, "y", 3), (3, "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    made = fim.fill_in_middle(docs, percent=percent, spm_percent=spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.back) for r in made.collect())
    want = []
    for i, t, _, _ in rows:
        n, form, a, b, out = plain(i, t, 7, percent, spm)
        want.append((i is None, i or 0, n, form, a or 0, b or 0, out, t or ""))
    assert got == sorted(want)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in fim.digest(fim.fill_in_middle(docs)).collect()}
    for r in docs.select("doc_id", "text").collect():
        n, form, a, b, out = plain(r.doc_id, r.text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[r.doc_id])[1:] == (n, form, a, b, sha(out), sha(r.text or ""))


def test_chunks_follow_the_content():
    rnd = random.Random(4)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(8000)).encode()
    cuts = []
    for head in (b"", b"some head that differs\n", b"y" * 777):
        data = head + passage
        ends = fim.chunk_ends(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        cuts.append({e - len(head) for e in ends})
    assert len(cuts[0] & cuts[1] & cuts[2]) >= len(cuts[0]) - 3 > 10
    run = fim.chunk_ends(b"q" * 200_000)
    assert max(b - a for a, b in zip([0, *run], run)) <= fim.LONGEST
    assert fim.chunk_ends(b"") == [] and fim.chunk_ends(b"short") == [5]
    long_ = bytes(rnd.choice(b"abcdefgh \n") for _ in range(fim._PIECE + 5000))  # cuts do not depend on the pieces
    tail = fim.chunk_ends(long_[1000:])
    assert set(tail[-20:]) == {e - 1000 for e in fim.chunk_ends(long_)[-20:]}


def test_memo_is_bounded_and_changes_nothing():
    rnd = random.Random(9)
    shared = "".join(" ".join(rnd.choice(["some", "words", "of", "a", "passage"]) for _ in range(8)) + "\n" for _ in range(300)).encode()
    memo, tiny = fim.Memo(), fim.Memo(limit=64)
    for i in range(20):
        data = f"head {i}\n".encode() + shared
        a, b = fim.Units(data, memo), fim.Units(data, tiny)
        assert a.n == b.n == 301
        assert [a.cut(k) for k in (0, 1, 150, 301)] == [b.cut(k) for k in (0, 1, 150, 301)]
    assert memo.hits > 0 and tiny.held <= max(64, fim.LONGEST)

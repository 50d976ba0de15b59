import random
import time

import numpy as np
import pyarrow as pa
import pytest
import regex

from jobtrail.llm import decontam
from jobtrail.llm.tables import read
from tests.llm.helpers import SF


_SINGLE = r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]"


def words(text):
    """Letters, marks and digits by Unicode class; one character a word where a script has no spaces."""
    return regex.findall(rf"{_SINGLE}|(?:(?!{_SINGLE})[\p{{L}}\p{{M}}\p{{N}}])+", (text or "").lower())


def greedy(doc, item, least):
    """Greedy string tiling by comparing all places."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for s in range(len(doc)):
                n = 0
                while p + n < len(item) and s + n < len(doc) and item[p + n] == doc[s + n] and not in_item[p + n] and not in_doc[s + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((p, s))
        if not found:
            return sum(in_item)
        for p, s in found:
            if not any(in_item[p: p + best]) and not any(in_doc[s: s + best]):
                in_item[p: p + best] = [True] * best
                in_doc[s: s + best] = [True] * best


def test_against_all_places(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randrange(6, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            w = items[rnd.randrange(12)][1].split()
            a = rnd.randrange(len(w))
            parts += w[a: a + rnd.randrange(2, 30)] + [rnd.choice("pq") for _ in range(rnd.randrange(3))]
        docs.append((i, " ".join(parts).upper() if i % 5 == 0 else ",\n".join(parts)))
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontam.contaminated_pairs(*frames(spark, docs, items), min_match=4, min_coverage=0.0).collect()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := greedy(words(t), words(x), 4))}
    assert got == want


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, item_id int, coverage string"),
            spark.createDataFrame([(*b, "clash") for b in items], "item_id long, text string, doc_id string"))


def test_documents(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if b.text in d.text}
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(docs, items).collect()}
    assert whole and whole <= found and len(found) <= len(whole) * 1.2
    kept = {r.doc_id for r in decontam.decontaminate(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_reordered_passages_blocks_and_edges(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    docs = [(1, "x " + " ".join(w[10:]) + " y y " + " ".join(w[:10])), (1, "x " + " ".join(w[10:]) + " y y " + " ".join(w[:10])), (2, " ".join(w[:8])), (3, None), (4, ""), (None, item), (5, "z " * 200_000 + item), (6, "alpha beta")]
    items = [(7, item), (7, item), (8, None), (9, "two words"), (None, ""), (10, "clean " + " ".join(w[::-1]))]
    for limit in (2_000_000, 30):  # one block, several
        monkeypatch.setattr(decontam, "BLOCK_WORDS", limit)
        d, b = frames(spark, docs, items)
        got = sorted(((r.doc_id, r.item_id, r.matched_words, r.item_words) for r in decontam.contaminated_pairs(d, b).collect()), key=str)
        assert got == sorted([(i, 7, 20, 20) for i in (1, 1, 5, None) for _ in range(2)], key=str)
        kept = decontam.decontaminate(d, b)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, 6] and kept.columns == d.columns
        assert decontam.contaminated_pairs(d.limit(0), b).collect() == [] and decontam.contaminated_pairs(d, b.limit(0)).collect() == []
        assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_short_items(spark):
    """Items of fewer words than a seed are found whole, by every text that holds them."""
    items = [(1, "Blue Whale"), (2, "blue whale"), (3, "42"), (4, "one two three four"), (5, "one two three four five"), (6, "..."), (7, None)]
    docs = [(1, "a BLUE, whale and a blue whale"), (2, "whale blue"), (3, "42"), (4, "is 42 one two three four five"), (5, "one two three"), (6, "one two three four"), (7, ""), (8, None), (9, "blue")]
    d, b = frames(spark, docs, items)
    got = sorted((r.doc_id, r.item_id, r.matched_words, r.item_words, r.coverage) for r in decontam.contaminated_pairs(d, b).collect())
    whole = lambda x, w: any(x[k: k + len(w)] == w for k in range(len(x) - len(w) + 1))
    want = sorted((i, j, len(words(t)), len(words(t)), 1.0) for i, x in docs for j, t in items if words(t) and whole(words(x), words(t)))
    assert got == want and (1, 1, 2, 2, 1.0) in got and (3, 3, 1, 1, 1.0) in got
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [2, 5, 7, 8, 9]
    short = b.filter("item_id < 4")
    assert sorted(r.doc_id for r in decontam.decontaminate(d, short).collect()) == [2, 5, 6, 7, 8, 9]


ITEM = "the quick brown fox jumps over the lazy dog while seven bright stars shine above our quiet harbor"


@pytest.mark.parametrize("between", [" ", "\u00a0", " \u2014 ", "\u2014", "\u201d, \u201c", "\u3000", "\u2026"])
def test_typographic_texts(spark, between):
    said = between.join(ITEM.split())
    docs = [(1, f"\u201cHe said:\u201d {said}\u2019s end"), (2, "nothing of the kind \u2014 here")]
    got = [(r.doc_id, r.matched_words) for r in decontam.contaminated_pairs(*frames(spark, docs, [(7, ITEM)])).collect()]
    assert got == [(1, 18)] and len(words(ITEM)) == 18
    assert [r.doc_id for r in decontam.decontaminate(*frames(spark, docs, [(7, ITEM)])).collect()] == [2]


def test_unspaced_scripts(spark):
    item, thai = "\u5b66\u800c\u65f6\u4e60\u4e4b\u4e0d\u4ea6\u8bf4\u4e4e\u6709\u670b\u81ea\u8fdc\u65b9\u6765", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e0a\u0e32\u0e27\u0e42\u0e25\u0e01"
    docs = [(1, "\u5b50\u66f0\uff1a" + item[:9] + "\uff1f" + item[9:] + "\u3002"), (2, "ab" + thai + "cd"), (3, item[:3])]
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontam.contaminated_pairs(*frames(spark, docs, [(7, item), (8, thai)]), min_coverage=0.0).collect()}
    assert got == {(d, i): n for d, t in docs for i, x in ((7, item), (8, thai)) if (n := greedy(words(t), words(x), 5))} and got[(1, 7)] == 15 and got[(2, 8)] == len(thai)


@pytest.mark.parametrize("pairs", [1, 40, 1 << 21])
def test_frequent_seeds_in_ranges(monkeypatch, pairs):
    """Whatever is laid out at once, tiles are those of all places."""
    rnd = random.Random(11)
    monkeypatch.setattr(decontam, "_PAIRS", pairs)
    for _ in range(25):
        items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 14)))) for i in range(3)]
        docs = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60))) for _ in range(3)] + ["a " * 50]
        got = {(r, items[i][0]): n for r, i, n in decontam.Seeds(items, 3).matches(pa.array(docs))}
        assert got == {(r, i): n for r, t in enumerate(docs) for i, x in items if (n := greedy(words(t), words(x), 3))}


def test_equal_words_stay_bounded():
    import tracemalloc

    seeds = decontam.Seeds([(i, "same " * (20 + i % 3)) for i in range(30)], 5)
    text = pa.array(["same " * 200_000])
    tracemalloc.start()
    began = time.time()
    got = list(seeds.matches(text))
    assert sorted(n for _, _, n in got) == sorted(20 + i % 3 for i in range(30))
    assert tracemalloc.get_traced_memory()[1] < 400e6 and time.time() - began < 120
    tracemalloc.stop()
    assert np.all([r == 0 for r, _, _ in got])

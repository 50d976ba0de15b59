import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobtrail.llm import langid, queries
from jobtrail.llm.tables import keep, read


def plain_grams(text):
    """The n-grams of a text, character by character."""
    out, last = [" "] * (langid.ORDER - 1), " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            out.append(c)
        last = c
    return ["".join(out[i: i + langid.ORDER]) for i in range(len(out) - langid.ORDER + 1)]


def plain_model(counts, alphabet):
    """Interpolated Kneser-Ney by dictionaries."""
    tables = []
    for order in range(langid.ORDER, 0, -1):
        n = Counter(counts.values())
        d = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.1))
        total, follow = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            follow[g[:-1]] += 1
        tables.append((order, dict(counts), total, follow, d))
        lower = defaultdict(set)
        for g in counts:
            lower[g[1:]].add(g[0])
        counts = {g: len(s) for g, s in lower.items()}

    def log2p(g):
        p = 1 / (alphabet + 1)
        for order, c, total, follow, d in reversed(tables):
            x = g[-order:]
            if total[x[:-1]]:
                p = max(c.get(x, 0) - d, 0) / total[x[:-1]] + d * follow[x[:-1]] / total[x[:-1]] * p
        return math.log2(p)

    return log2p


def test_against_dictionaries(spark):
    rows = [("aa", "Hello, hello wörld! 12 hello"), ("aa", "the world says hello"), ("bb", "bonjour le monde"), ("bb", "le monde dit: bonjour\nà tous"), (None, "hello le zzz"), ("bb", None)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    models = langid.train(docs)
    counts = {x: Counter(g for lang, t in rows if lang == x for g in plain_grams(t)) for x in ("aa", "bb")}
    alphabet = len({g[-1] for c in counts.values() for g in c})
    plain = {x: plain_model(c, alphabet) for x, c in counts.items()}
    for r in langid.cross_entropies(docs, models, ["doc_id"]).collect():
        grams = plain_grams(rows[r.doc_id][1])
        if not grams:
            assert (r.lang_pred, r.score, r.chars) == ("und", 0.0, 0)
            continue
        want = {x: -np.mean([p(g) for g in grams]) for x, p in plain.items()}
        assert r.chars == len(grams) and r.lang_pred == min(want, key=want.get)
        assert r.entropy == pytest.approx(min(want.values()))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in read(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = queries.op3_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.005


def test_edges_and_rejection(spark):
    good = [(i, "xx", f"some plain words that come again and again in every text {'so ' * (i % 5)}of this table") for i in range(60)]
    odd = [(100, None, "Ж" * 400), (101, None, "123 456"), (102, "xx", ""), (103, None, None), (None, None, "some plain words"), (104, None, "some plain words that come again " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in good + odd + good[:1]], "doc_id long, lang string, text string, lang_pred string, score double")
    got = langid.identify(docs, "lang is not null", ["doc_id"]).collect()
    assert len(got) == 67
    by = {r.doc_id: r for r in got}
    assert by[100].rejected and by[101].rejected and by[101].lang_pred == "und" and by[103].rejected and by[102].rejected
    assert not any(by[i].rejected for i in range(60)) and by[104].lang_pred == "xx" and not by[104].rejected
    assert langid.identify(docs.limit(0), "true", ["doc_id"]).collect() == []
    assert {r.rejected for r in langid.identify(docs, "false", ["doc_id"]).collect()} == {True}


def test_no_gram_is_cut(spark, monkeypatch):
    """A language with more than two million distinct n-grams does not push out a rare one; blocks change nothing."""
    rng = np.random.default_rng(7)
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 40_000))) for _ in range(60)]
    rare = "zygote quickly jumped"
    docs = spark.createDataFrame([(i, "aa", t) for i, t in enumerate(many)] + [(100, "zz", rare)], "doc_id long, lang string, text string")
    models = langid.train(docs)
    few = docs.filter("doc_id = 100 or doc_id < 2")
    got = {r.doc_id: r for r in langid.cross_entropies(few, models, ["doc_id"]).collect()}
    assert got[0].lang_pred == "aa" and got[100].lang_pred == "zz"
    counts = {"aa": Counter(g for t in many for g in plain_grams(t)), "zz": Counter(plain_grams(rare))}
    assert len(counts["aa"]) > 2_000_000
    alphabet = len({g[-1] for c in counts.values() for g in c})
    for lang, i, text in (("zz", 100, rare), ("aa", 0, many[0])):
        log2p = plain_model(counts[lang], alphabet)
        assert got[i].entropy == pytest.approx(-np.mean([log2p(g) for g in plain_grams(text)]))
    monkeypatch.setattr(langid, "BLOCK_ROWS", 1000)
    rows = docs.filter("doc_id = 100").unionByName(spark.createDataFrame([(0, "aa", many[0][:5000])], docs.schema))
    assert len(langid.train(rows).orders[0][2]) > 3
    small = langid.cross_entropies(rows, langid.train(rows), ["doc_id"]).collect()
    monkeypatch.undo()
    assert sorted(small) == sorted(langid.cross_entropies(rows, langid.train(rows), ["doc_id"]).collect())


def test_letters_above_the_basic_plane_differ(spark):
    rng = np.random.default_rng(3)
    text = lambda first, n: " ".join("".join(chr(first + int(c)) for c in rng.integers(0, n, 6)) for _ in range(40))
    scripts = {"adlam": (0x1E922, 30), "chakma": (0x11103, 30), "ext_b": (0x20000, 30)}
    rows = [(10 * i + k, lang, text(*of)) for i, (lang, of) in enumerate(scripts.items()) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in langid.cross_entropies(docs, langid.train(docs), ["doc_id"]).collect()}
    assert [got[i].lang_pred for i, _, _ in rows] == [lang for _, lang, _ in rows]
    counts = {x: Counter(g for _, lang, t in rows if lang == x for g in plain_grams(t)) for x in scripts}
    alphabet = len({g[-1] for c in counts.values() for g in c})
    for i, lang, t in rows[::5]:
        log2p = plain_model(counts[lang], alphabet)
        assert got[i].entropy == pytest.approx(-np.mean([log2p(g) for g in plain_grams(t)]))


def test_blocks_read_their_own_files(spark, monkeypatch):
    rows = [(1, "xx", "plain words of a short text"), (2, "yy", "und ein anderer kurzer Satz")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole = langid.train(docs)
    monkeypatch.setattr(langid, "BLOCK_ROWS", 10)
    written = []
    monkeypatch.setattr(langid, "keep", lambda df, name, by=None: written.append((name, by, keep(df, name, by))) or written[-1][2])
    parted = langid.train(docs)
    _, by, table = next(w for w in written if w[0] == "blocks")
    assert by == "block" and len(parted.orders[0][2]) > 3 and table.inputFiles() and all("block=" in f for f in table.inputFiles())
    plan = table.filter("block = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan
    context, letter, _ = next(langid.grams([r[2] for r in rows]))
    assert np.array_equal(whole.log2p(context, letter), parted.log2p(context, letter))


def test_texts_are_counted_in_small_pieces(monkeypatch):
    texts = ["word " * 40, None, "", "x" * 500, "été 12 b"] * 20
    whole = list(langid.grams(texts))
    assert len(whole) == 1
    monkeypatch.setattr(langid, "PIECE", 300)
    parts = list(langid.grams(texts))
    assert max(len(p[0]) for p in parts) <= 300 + 500 and len(parts) > 10
    assert all((np.concatenate([p[i] for p in parts]) == whole[0][i]).all() for i in range(3))

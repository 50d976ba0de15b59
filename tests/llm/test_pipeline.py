"""The stages in a row, each held against what it must keep."""

import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from jobtrail.llm import decontam, jaccard, langid, mixing, secrets
from jobtrail.llm.tables import read
from tests.llm import test_secrets as plain_secrets
from tests.llm.helpers import SF
from tests.llm.test_decontam import greedy, words
from tests.llm.test_jaccard import brute
from tests.llm.test_langid import plain_grams, plain_model


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
        if name != "source_mix":
            assert kept.columns == columns and set(after) <= set(before)
        if name == "language_id":
            rejected = {r.doc_id for r in langid.identify(docs, "lang is not null", ["doc_id"]).filter("rejected").collect()}
            assert set(after) == set(before) - rejected
        elif name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in brute([(r.doc_id, r.text) for r in before.values()], 5, 80) if c == d}
        elif name == "decontamination":
            assert set(after) == set(before) - {r.doc_id for r in decontam.contaminated_pairs(docs, read(spark, SF, "benchmark")).collect()}
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert {d for d in after if after[d].text != before[d].text} == {d for d in before if secrets.scan_text(before[d].text)}
            assert all(not secrets.scan_text(r.text) and r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before)
        docs = kept
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (1, "quite another text of some words", 0), (2, "a b c d e f g", 1), (None, "a b c d e f g", 2), (None, None, 3), (3, "", 4), (4, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, jaccard.keep_one(docs).collect()), key=str)
    assert got == sorted([r for i, r in enumerate(rows) if i not in (1, 3)], key=str)
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_no_copy_of_the_texts_on_the_way(spark, monkeypatch, tmp_path):
    """What these stages write beside their result holds keys and figures only: it grows with the rows, not with the texts."""
    written = []
    for module in (corpus_pipeline, langid, jaccard):
        monkeypatch.setattr(module, "keep", lambda df, name, *a, f=module.keep, **b: (written.append((name, df.schema.simpleString())), f(df, name, *a, **b))[1])
    docs = read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {"language-scores", "first-links"} <= {name for name, _ in written}
    assert [x for x in written if re.search(r"\b(text|row):", x[1])] == []


def test_language_of_repeated_rows(spark):
    """Rows go or stay by their text alone, as often as they come, with or without an id or a language."""
    docs = read(spark, SF, "documents").filter("lang is not null").limit(40)
    odd = [(None, None, None), (-1, None, None), (-2, None, ""), (-3, "xx", "12 34"), (-3, "xx", "12 34"), (-4, None, "\u0416" * 400), (None, "xx", "\u0416" * 400)]
    more = spark.createDataFrame(odd, "doc_id long, lang string, text string")
    good = docs.select(F.col("doc_id").cast("long"), "lang", "text").cache()
    twice = good.filter("doc_id % 2 = 0").withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    rows = good.unionByName(good).unionByName(twice).unionByName(more)
    scored = langid.identify(rows.select("lang", "text", F.struct(*rows.columns).alias("row")), "lang is not null", ["row"])
    want = scored.filter("not rejected").select("row.*").collect()
    got = corpus_pipeline.language_id(spark, rows, SF).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) >= 80
    assert not {-1, -2, -3} & {r.doc_id for r in got}


def test_empty_documents(spark, tmp_path):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def plain_languages(rows):
    """The ids of ``(id, lang, text)`` rows whose text stays, by dictionaries."""
    counts = {}
    for _, lang, text in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    counts = {lang: c for lang, c in counts.items() if c}
    alphabet = len({g[-1] for c in counts.values() for g in c})
    models, known, scored = {lang: plain_model(c, alphabet) for lang, c in sorted(counts.items())}, {}, []
    for i, lang, text in rows:
        grams = plain_grams(text)
        for g in grams:
            if g not in known:
                known[g] = {x: m(g) for x, m in models.items()}
        entropy = {x: -sum(known[g][x] for g in grams) / max(1, len(grams)) for x in models}
        best = min(entropy, key=entropy.get)
        scored.append((i, lang, best if grams else None, entropy[best], len(grams)))
    stay = set()
    for x in models:
        own = [(e, n) for _, lang, best, e, n in scored if lang == best == x]
        if not own:
            continue
        mean = sum(e * n for e, n in own) / sum(n for _, n in own)
        excess = lambda e, n: (e - mean) * math.sqrt(min(n, langid.SCALE_CHARS))
        limit = sorted(excess(e, n) for e, n in own)[math.ceil(0.999 * len(own)) - 1]
        stay |= {i for i, _, best, e, n in scored if best == x and not (excess(e, n) > langid.SLACK * max(limit, 0) and e - mean > langid.LEAST_EXCESS)}
    return stay


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage's own input, with some rows that it must act on, by versions that share no code with the operators."""
    docs = read(spark, SF, "documents")
    items = [(b.item_id, words(b.text)) for b in read(spark, SF, "benchmark").collect()]
    item = read(spark, SF, "benchmark").first().text
    key = "\n".join(plain_secrets.lines_of(plain_secrets.PKCS8))
    odd = {"language_id": [(-1, "\u0416" * 400), (-2, "123 456")], "decontamination": [(-3, f"first {item} last")],
           "secret_scan": [(-4, f"a key\n{key}\nand more words"), (-5, "password = hunter2hunter2 end")]}
    row = docs.limit(1).drop("doc_id", "text").withColumn("lang", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        more = row.crossJoin(spark.createDataFrame(odd.get(name, []), "doc_id long, text string"))
        docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{tmp_path}/to-{name}")
        docs = spark.read.parquet(f"{tmp_path}/to-{name}")
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
        if name == "language_id":
            assert set(after) == plain_languages([(r.doc_id, r.lang, r.text) for r in before.values()]) and not {-1, -2} & set(after)
        elif name == "decontamination":
            gone = set()
            for d, r in before.items():
                x = words(r.text)
                seeds = {tuple(x[k: k + 5]) for k in range(len(x) - 4)}
                if any(greedy(x, w, 5) >= 0.6 * len(w) for _, w in items if any(tuple(w[k: k + 5]) in seeds for k in range(len(w) - 4))):
                    gone.add(d)
            assert set(after) == set(before) - gone and -3 in gone
        elif name == "secret_scan":
            for d, r in before.items():
                want, at = "", 0
                spans = plain_secrets.plain(r.text)
                if d == -4:  # the one key; the given documents hold none
                    spans = [("der", r.text.index(key), r.text.index(key) + len(key))]
                for _, a, b in spans:
                    want += r.text[at:a] + "[secret]" if a >= at else ""
                    at = max(at, b)
                assert after[d].text == want + r.text[at:] and after[d].n_chars == len(after[d].text)
            assert after[-4].text == "a key\n[secret]\nand more words" and after[-5].text == "[secret] end"
        elif name == "source_mix":
            columns = [c for c in ("doc_id", "size", "source_size", "target", "taken", "source") if c in kept.columns]
            con = duckdb.connect()
            con.execute(f"create table documents as select doc_id, source, text from read_parquet('{tmp_path}/secret_scan/*.parquet')")
            want = con.execute(f"select {', '.join(columns)} from ({mixing.mix_sql()})").fetchall()
            assert "taken" in columns and sorted(map(str, want)) == sorted(str(tuple(r)) for r in kept.select(*columns).collect())
        docs = kept

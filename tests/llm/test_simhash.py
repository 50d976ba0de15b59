"""SimHash links against brute force over all pairs, on the given documents and on crowded fingerprints."""

import random

import pytest
import xxhash

from jobtrail.llm import simhash
from jobtrail.llm.tables import read
from tests.llm.helpers import SF, WORD, lower


def plain_fingerprint(text, k=3):
    words = WORD.findall(lower(text or ""))
    runs = [" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """(id, fingerprint) -> (id, component) by comparing all pairs of distinct fingerprints."""
    first = {}
    for i, f in prints:
        first[f] = min(i, first.get(f, i))
    parent = {f: f for f in first}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    nodes = list(first)
    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for f, i in first.items():
        low[root(f)] = min(i, low.get(root(f), i))
    return sorted((i, low[root(f)]) for i, f in prints)


def test_documents(spark):
    docs = read(spark, SF, "documents")
    got = simhash.near_duplicates(docs).collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{f:016x}") for i, f in prints)
    assert sorted((r.doc_id, r.component_id) for r in got) == brute(prints)
    assert any(r.doc_id != r.component_id for r in got)


def test_texts_of_all_kinds():
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "one", "One two", "É b  c d e", "a b c", "x " * 200_000, "ab\x00cd \x1f e f",
             " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(3000))]
    for t in texts[:7] + texts[8:]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
    one = xxhash.xxh64(b"x x x", seed=42).intdigest()
    assert simhash.fingerprint(texts[7]) == one  # all shingles equal, several blocks
    assert simhash.fingerprint("a b c d e", k=2) == plain_fingerprint("a b c d e", 2)


def families():
    rnd = random.Random(7)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    found = {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 + 1}
    for c in centres:
        for _ in range(150):  # many distinct fingerprints in one variant
            f = c
            for _ in range(rnd.randrange(0, 5)):
                f ^= 1 << rnd.randrange(64 if rnd.random() < 0.3 else 12)
            found.add(f)
    found |= {rnd.getrandbits(64) for _ in range(200)}
    return sorted(found)


@pytest.mark.parametrize("crowd", [16, 2, 10_000])
def test_links_whatever_the_crowd(spark, crowd):
    nodes = families()
    signed = [f - (1 << 64) if f >> 63 else f for f in nodes]
    from jobtrail.llm.components import components

    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), crowd)
    label = {r.node: r.component for r in components(edges).collect()}
    want = dict(brute(list(zip(signed, nodes))))
    groups, expected = {}, {}
    for f in signed:
        groups.setdefault(label.get(f, f), set()).add(f)
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_variants_meet_exactly_where_a_segment_differs_by_one_bit(spark):
    rnd = random.Random(1)
    a = rnd.getrandbits(64)
    rows = [(a,)] + [(a ^ (1 << i) ^ (1 << j),) for i, j in ((3, 40), (5, 9), (33, 60))] + [(a ^ 0b11 << 40 ^ 0b101 << 2,)]
    signed = [f - (1 << 64) if f >> 63 else f for f, in rows]
    seen = {}
    for r in simhash._variants(spark.createDataFrame([(f,) for f in signed], "fingerprint long")).collect():
        seen.setdefault(r.fingerprint, set()).add(r.variant)
    assert all(len(v) == 64 for v in seen.values())
    shared = [len(seen[signed[0]] & seen[f]) for f in signed[1:]]
    assert shared == [2, 32, 32, 0]  # one variant of each segment; a whole segment; two bits in each: none


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(7, None, "x", 1), (8, "", "y", 2), (None, "a b c d", None, 3), (5, "a b c d", "z", 4), (5, "a b c d", "z", 4), (4, "A b\tc d", "w", 5), (5, "other words here entirely now", "q", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = sorted((str(r.doc_id), r.component_id, r.fingerprint == "0" * 16) for r in simhash.near_duplicates(docs).collect())
    assert got == [("4", 4, False), ("5", 4, False), ("5", 4, False), ("5", 5, False), ("7", 7, True), ("8", 7, True), ("None", None, False)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_variants_are_not_broadcast(spark, monkeypatch):
    """The exploded rows look small to Spark; whatever their number, they stay out of the driver."""
    plans = {}

    def kept(df, name, by=None):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(simhash, "keep", kept)
    rnd = random.Random(11)
    prints = list({rnd.getrandbits(63) for _ in range(2000)}) + [5, 7]
    nodes = spark.createDataFrame([(f,) for f in prints], "fingerprint long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert [tuple(r) for r in simhash.links(nodes).distinct().collect()] == [(5, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plans["variants"] and "Broadcast" not in plans["variants"]

import duckdb
import pytest

from jobtrail.llm import mixing
from jobtrail.llm.tables import read
from tests.llm.helpers import SF


def rows(spark, data):
    return spark.createDataFrame([(*r, 1, "clash") for r in data], "doc_id long, source string, text string, size int, target string")


def by_rounds(sizes, limit=3):
    """Targets by giving the excess to the sources below their limit until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        out = {s: limit * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and out[s] > limit * sizes[s]}
        if not above:
            return out
        full |= above


def test_documents_near_targets(spark):
    docs = read(spark, SF, "documents")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size >= r.size
    assert target == pytest.approx(by_rounds(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_edges_equal_sql(spark):
    data = [(1, "b", "x " * 500), (2, "b", "y " * 300), (3, "a", "z " * 4), (4, None, "n " * 700), (5, "é", None), (6, "c", ""), (7, "Z", "\x0bw\x0c " * 90), (8, "d", "long " * 100_000), (None, "b", "q q"), (9, "b", "x " * 500), (9, "b", "x " * 500)]
    docs = rows(spark, data)
    out = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "source", "text").toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    con.sql("create table documents as select doc_id, source, text from given")
    want = con.sql(f"select doc_id, size, source_size, target, taken, source from ({mixing.mix_sql()})").fetchall()
    assert got == sorted(map(str, want))
    sizes = {}
    for r in out.collect():
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken <= 3 * r.size
    assert {r.source: r.target for r in out.collect()} == pytest.approx(by_rounds(sizes))
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(rows(spark, [(1, "a", None), (2, "b", "")])).collect()} == {0}


def test_schedule_is_even_in_every_stretch(spark):
    sources = mixing.targets(spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate([("a", 4000), ("b", 4000), ("c", 4000)])], "doc_id long, source string, size long"))
    slots = {r.slot: r for r in mixing.schedule(sources).collect()}
    share = {1: 1 / 6, 2: 2 / 6, 3: 3 / 6}
    n = len(slots)
    assert sorted(slots) == list(range(n))
    for a, b in ((0, 600), (1000, 1300), (n - 500, n)):
        for sid, part in share.items():
            assert abs(sum(slots[i].sid == sid for i in range(a, b)) - part * (b - a)) < 5
    for sid in share:
        assert sorted(r.rank for r in slots.values() if r.sid == sid) == list(range(sum(r.sid == sid for r in slots.values())))

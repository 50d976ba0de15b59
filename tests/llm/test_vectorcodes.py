"""Vector codes against brute force in plain integers; the tree against all distances."""

import hashlib
import random

import numpy as np
import pytest

from jobtrail.llm import vectorcodes as vc


def plain(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v], l) for i, v, l in rows]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * w: (p + 1) * w])
    seeds, ids = [], set()
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        if i not in ids and len(ids) < entries:
            ids.add(i)
            seeds.append(v)
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(v, p)[1], []).append(cut(v, p))
            moved.append([tuple(sum(c) // len(of[k]) for c in zip(*of[k])) if k in of else e for k, e in enumerate(books[p])])
        books = moved
    out, by_label = [], {}
    for i, v, l in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), l))
        by_label[l] = by_label.get(l, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[l], sha) for i, c, e, l in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, error string"


@pytest.mark.parametrize("spread", [1, 40])
def test_vectors(spark, spread):
    rnd = random.Random(spread)
    # few distinct values: ties, equal entries and unused ones
    rows = [(i, [rnd.randrange(-3 * spread, 3 * spread) / 256 + 0.001 for _ in range(32)], rnd.choice([None, 1, 2, 3])) for i in rnd.sample(range(1000), 150)]
    rows += [rows[0], rows[0], (None, rows[1][1], None)]
    bad = [(1001, None, 1), (1002, [], 1), (1003, [0.5] * 31, 1), (1004, [0.5] * 31 + [None], 1), (1005, [float("nan")] * 32, 2), (1006, [0.5] * 31 + [float("-inf")], None), (1007, [0.5] * 16, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA).repartition(4)
    got = sorted(map(tuple, vc.vector_codes(docs, parts=8, entries=40, rounds=2).collect()), key=str)
    assert got == plain(rows, 8, 40, 2)


def test_few_and_no_vectors(spark):
    rows = [(3, [0.5, -0.25], 1), (2, [0.1, 0.9], None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, vc.vector_codes(docs, parts=2, entries=64).collect()), key=str) == plain(rows, 2, 64, 2)
    assert vc.vector_codes(docs.limit(0)).collect() == []
    assert vc.vector_codes(docs.filter("false").unionByName(spark.createDataFrame([(1, None, 1, "x")], SCHEMA))).collect() == []


@pytest.mark.parametrize("width,size,kind", [(4, 64, "spread"), (4, 64, "grid"), (1, 64, "grid"), (3, 5, "spread"), (4, 300, "spread"), (2, 64, "equal"), (4, 64, "huge")])
def test_tree_equals_all_distances(width, size, kind):
    rng = np.random.default_rng(width * size)
    limit = {"spread": 200, "grid": 2, "equal": 1, "huge": vc.BOUND}[kind]
    book = rng.integers(-limit, limit, (size, width)) if kind != "equal" else np.zeros((size, width), np.int64)
    q = np.concatenate([rng.integers(-limit, limit + 1, (500, width)), book, (book + book[::-1]) // 2])
    index, best = vc.Gnat(book).nearest(q)
    all_ = vc._squares(q, book)
    assert (index == all_.argmin(1)).all() and (best == all_.min(1)).all()


def test_subtrees_are_left_out():
    rng = np.random.default_rng(0)
    book = np.concatenate([rng.integers(-20, 20, (16, 4)) + c for c in ([0] * 4, [900] * 4, [-900, 900, 0, 0], [0, -900, 900, 0])])
    q = book[rng.integers(0, 64, 2000)] + rng.integers(-5, 5, (2000, 4))
    best, index = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), np.iinfo(np.int64).max)
    assert vc.Gnat(book).search(q, np.arange(len(q)), best, index) < 0.6 * q.shape[0] * len(book)

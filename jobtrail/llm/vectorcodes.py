"""Vector codes: product quantization whose nearest entries are found in a GNAT over each codebook.

Vectors of integers (``floor(256 * x)``) are cut into equal parts; each part is coded by the index of the nearest entry
of its codebook. A codebook starts from the vectors of smallest id and is moved to the mean of its parts a
fixed number of times.

* ``Gnat``: split points chosen far from each other, every other entry with the nearest of them. Each split point
  keeps the range of its distances to the entries of every subtree. A query measures the split points; a subtree goes
  when the query's distance to any split point lies further outside that range than the best distance so far.
  Distances are square roots of exact integers, rounded outwards by more than their error, and a subtree goes
  only if it is strictly further away, so whatever could win or tie is measured: exact integers decide, ties by index.
* Vectors stay where they lie. A round reads them once; each task adds up its parts (at most one row for each number of the
  codebooks), Spark adds up the tasks. The codebooks, ``entries`` x dimension numbers, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.tables import keep

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this bound, so that no sum of squares leaves 64 bits.
BOUND = 1 << 26
#: Split points of a node; entries of a node that are measured without splitting.
FAN, LEAF = 6, 6
#: Vectors measured at once.
_ROWS = 4096
_UP, _DOWN = 1 + 2.0**-48, 1 - 2.0**-48


def _squares(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``q`` to all rows of ``e``, as exact integers."""
    out = np.zeros((len(q), len(e)), np.int64)
    for k in range(q.shape[1]):
        d = q[:, k, None] - e[None, :, k]
        out += d * d
    return out


class Gnat:
    """A search tree over the entries ``ids`` of a codebook (integer vectors)."""

    def __init__(self, book: np.ndarray, ids: np.ndarray | None = None):
        ids = np.arange(len(book)) if ids is None else ids
        self.children: list[Gnat | None] = []
        if len(ids) <= LEAF:
            self.ids, self.points = ids, book[ids]
            return
        # split points: one after the other the entry furthest from those chosen
        split = [0]
        near = _squares(book[ids], book[ids[:1]])[:, 0]
        while len(split) < FAN:
            split.append(int(near.argmax()) if near.max() else next(i for i in range(len(ids)) if i not in split))
            near = np.minimum(near, _squares(book[ids], book[ids[split[-1:]]])[:, 0])
        self.ids, self.points = ids[split], book[ids[split]]
        rest = np.delete(ids, split)
        away = _squares(book[rest], self.points)
        home = away.argmin(1)
        self.low, self.high = np.zeros((FAN, FAN)), np.zeros((FAN, FAN))
        for j in range(FAN):
            own = home == j
            if own.any():
                roots = np.sqrt(away[own].astype(float))
                self.low[:, j], self.high[:, j] = roots.min(0) * _DOWN, roots.max(0) * _UP
            self.children.append(Gnat(book, rest[own]) if own.any() else None)

    def search(self, q: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Bring ``best`` (squared distance) and ``index`` of the query ``rows`` up to date; the number of distances measured."""
        d = _squares(q[rows], self.points)
        measured = d.size
        for j, entry in enumerate(self.ids):
            better = (d[:, j] < best[rows]) | ((d[:, j] == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = d[better, j], entry
        if self.children:
            root = np.sqrt(d.astype(float))
            low, high = root * _DOWN, root * _UP
            for j, child in enumerate(self.children):
                if child is not None:
                    reach = np.sqrt(best[rows].astype(float))[:, None] * _UP
                    gone = ((low > (self.high[:, j] + reach) * _UP) | (self.low[:, j] > (high + reach) * _UP)).any(1)
                    if not gone.all():
                        measured += child.search(q, rows[~gone], best, index)
        return measured

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query (ties: the lowest) and its squared distance."""
        best, index = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), np.iinfo(np.int64).max)
        self.search(q, np.arange(len(q)), best, index)
        return index, best


def _usable(vectors: DataFrame, parts: int, dim: int | None) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & ((F.size(v) > 0) & (F.size(v) % parts == 0) if dim is None else F.size(v) == dim) & finite)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """``floor(SCALE * x)`` of an Arrow column of vectors without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64).reshape(len(column), dim)


def _assigned(batches, trees: list[Gnat], dim: int):
    """Integer vectors, codes and squared distances of the rows of each piece of the batches."""
    width = dim // len(trees)
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            piece = b.slice(lo, _ROWS)
            x = _integers(piece.column("embedding"), dim)
            found = [t.nearest(x[:, i * width: (i + 1) * width]) for i, t in enumerate(trees)]
            yield piece, x, np.stack([f[0] for f in found], 1), sum(f[1] for f in found)


def _moved(vectors: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floor of the mean of its parts, unused ones as they were."""
    trees, entries, width = [Gnat(b) for b in books], len(books[0]), dim // len(books)

    def run(batches):
        total = np.zeros((len(trees), entries, width + 1), np.int64)
        for _, x, codes, _ in _assigned(batches, trees, dim):
            for i in range(len(trees)):
                order = np.argsort(codes[:, i], kind="stable")
                used, start = np.unique(codes[order, i], return_index=True)
                total[i, used, :width] += np.add.reduceat(x[order, i * width: (i + 1) * width], start, axis=0)
                total[i, used, width] += np.diff(np.append(start, len(order)))
        i, e = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat((i * entries + e).astype(np.int32), width + 1)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(i))),
            pa.array(total[i, e].reshape(-1))], ["entry", "place", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "entry int, place int, total long").groupBy("entry", "place").agg(F.sum("total").alias("total"))
    made = [b.copy() for b in books]
    got = {(r.entry, r.place): r.total for r in sums.collect()}  # at most entries * (dim + parts) numbers
    for (entry, place), value in got.items():
        if place < width:
            made[entry // entries][entry % entries, place] = value // got[entry, width]
    return made


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """Dimension and codebooks. ``vectors (vec_id, embedding)``; the dimension is that of the smallest vec_id."""
    usable = _usable(vectors, parts, None).filter("vec_id is not null")
    head = usable.select("vec_id", F.size("embedding").alias("dim")).orderBy("vec_id", "dim").first()
    if head is None:
        return 0, []
    dim = head.dim
    kept = _usable(vectors, parts, dim)
    ids = [r.vec_id for r in kept.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = kept.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    start = _integers(pa.array([r.embedding for r in seeds], pa.list_(pa.float64())), dim)
    books = [np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _moved(kept, books, dim)
    return dim, books


def books_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, label, code array<int>, error long)`` of the usable rows."""
    trees = [Gnat(b) for b in books]

    def run(batches):
        for piece, _, codes, error in _assigned(batches, trees, dim):
            code = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.astype(np.int32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = _usable(vectors, max(1, len(books)), dim).select("vec_id", "label", "embedding")
    rows = rows if books else rows.limit(0)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code array<int>, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, embedding, label)`` -> ``(vec_id, code, error, label_error, codebooks_sha256)``, one row for each usable row.

    ``code``: two hex digits for each part. ``error``: squared distances summed over the parts; ``label_error``: errors
    summed over rows of equal labels, nulls together. Rows go whose vector is null, empty or holds a null or a
    non-finite component, whose length ``parts`` does not divide, or differs from that of the smallest usable vec_id. Components
    beyond +-2**18 count as that bound. Repeated rows are coded alike and count as often as they come; of rows of
    one vec_id with different vectors the smallest vector is the seed. A null vec_id is coded but never a
    seed. With fewer ids than ``entries`` the codebooks are smaller. Further columns of ``vectors`` are ignored; an
    empty table gives an empty one.
    """
    dim, books = train(vectors.select("vec_id", "embedding"), parts, entries, rounds)
    coded = encode(vectors, dim, books)
    if books:
        coded = keep(coded, "codes")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Brute force: every part against every entry, with the rounds written out."""
    steps, book = [], "book0"
    nearest = lambda book: f"""(SELECT vec_id, label, p, x, min_by(e, d * {2 * entries} + e) AS e, min(d) AS d FROM (
        SELECT v.vec_id, v.label, v.p, v.x, b.e, CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM cut v JOIN {book} b USING (p)) m GROUP BY ALL)"""  # noqa: E731
    for r in range(rounds):
        steps.append(f"""mean{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY k) AS x FROM (
    SELECT p, e, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS k FROM {nearest(book)} a) u GROUP BY p, e, k) c GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN mean{r} m USING (p, e))""")
        book = f"book{r + 1}"
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM whole, (SELECT unnest(range({parts})) AS p) r),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, e, x FROM cut JOIN first USING (vec_id)),
{", ".join(steps)},
coded AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {nearest(book)} f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM {book}) AS codebooks_sha256 FROM coded"""

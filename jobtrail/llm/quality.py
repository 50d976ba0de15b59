"""Quality classifier: ridge regression on random Fourier features of document statistics.

Every text is reduced to ``STATISTICS`` (counts and ratios over the whole text). Random cosine features
approximate a Gaussian kernel over the standardized statistics; each task sums its part of the
normal equations, Spark adds the parts, and the small system is solved once. Ridge scores become
probabilities by isotonic regression over ``BINS`` score bins whose counts Spark sums. All labelled
rows take part; what reaches the driver has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm import textkit as tk
from jobtrail.llm.tables import keep

FEATURES = 160
RIDGE = 1e-4
BANDWIDTH = 2.5
SEED = 7
BINS = 400

STATISTICS = ("log_words", "log_bytes", "word_bytes", "capitals", "digits", "symbols", "exclamations", "punctuation", "not_ascii", "lines",
              "distinct_words", "same_as_previous", "most_frequent", "distinct_runs", "distinct_lines")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[np.frombuffer(chars.encode(), np.uint8)] = 1
    return t


_CLASSES = {
    "capitals": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _table("0123456789"), "symbols": _table("#*$%&|<>"), "exclamations": _table("!"),
    "punctuation": _table(".,;:?'\"()-"), "not_ascii": (np.arange(256) >= 0xC0).astype(np.int64), "lines": _table("\n")}
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; ratios of an empty text are 0."""
    data, offsets = tk.utf8(column)
    n = np.diff(offsets)
    words, at = tk.word_hashes(data, offsets)
    runs, run_at = tk.shingle_hashes(words, at, 4)
    lines, line_at = tk.word_hashes(data, offsets, _NEWLINE)
    count = np.diff(at)
    sums = {}
    for name, table in _CLASSES.items():
        sums[name] = np.zeros(len(n), np.int64)
        for a in range(0, len(data), tk.PIECE):
            total = np.concatenate([[0], np.cumsum(table[data[a: a + tk.PIECE]])])
            inside = np.clip(offsets - a, 0, len(total) - 1)
            sums[name] += np.diff(total[inside])
    ratio = lambda x, y: x / np.maximum(y, 1)
    out = [np.log1p(count), np.log1p(n), np.log1p(ratio(n, count))]
    out += [ratio(sums[c], n) for c in ("capitals", "digits", "symbols", "exclamations", "punctuation", "not_ascii")]
    out.append(ratio(sums["lines"], count))
    per = np.zeros((len(n), 5))
    for i in np.flatnonzero(count):
        w, s, x = words[at[i]: at[i + 1]], runs[run_at[i]: run_at[i + 1]], lines[line_at[i]: line_at[i + 1]]
        _, c = np.unique(w, return_counts=True)
        per[i] = len(c) / len(w) ** 0.8, (w[1:] == w[:-1]).mean() if len(w) > 1 else 0, c.max() / len(w), len(np.unique(s)) / len(s), len(np.unique(x)) / max(1, len(x))
    return np.column_stack([*out, per])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, x)``: the statistics of each row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(statistics(b.column("text"))), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum of ``part(x, y)`` (a vector of ``size``) over all rows: within tasks by numpy, across tasks by Spark."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    table = rows.select("x", "y").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[table.cell.to_numpy()] = table.value.to_numpy()
    return out


class Model:
    """Standardization, random features, ridge weights and calibration."""

    def __init__(self, mean, scale):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(d, FEATURES)) / BANDWIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.places, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn + self.phase
        return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.places, self.levels)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means that fit ``sums / counts`` best (pool adjacent violators)."""
    pools: list[list[float]] = []
    for s, n in zip(sums, counts):
        pools.append([s, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in pools])


def fit(rows: DataFrame) -> Model:
    """``rows (x, y)`` with ``y`` in 0 to 1 -> model. Without rows every score is 0.5."""
    rows = keep(rows, "training")
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * d + 1)
    n = moments[0]
    if not n:
        return Model(np.zeros(d), np.ones(d))
    mean = moments[1: d + 1] / n
    model = Model(mean, np.sqrt(np.maximum(moments[d + 1:] / n - mean**2, 1e-8)))
    m = FEATURES + 1
    upper = np.triu_indices(m)

    def equations(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    total = _summed(rows, equations, len(upper[0]) + m)
    gram = np.zeros((m, m))
    gram[upper] = total[: len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    model.weights = np.linalg.solve(gram + RIDGE * n * np.eye(m), total[len(upper[0]):])

    def binned(x, y):
        place = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place, y, BINS), np.bincount(place, minlength=BINS)])

    bins = _summed(rows, binned, 2 * BINS)
    some = bins[BINS:] > 0
    model.places = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[some]
    model.levels = isotonic(bins[:BINS][some], bins[BINS:][some])
    return model


def classify(docs: DataFrame, labels: DataFrame, learn: str) -> DataFrame:
    """``docs (doc_id, text)``, ``labels (doc_id, quality)`` -> ``(doc_id, score)``, one row for each row of ``docs``.

    Learns from labelled rows whose ``doc_id`` satisfies ``learn`` (null: no). Null labels count as absent,
    several labels of a document as their mean; a null text as empty. Further columns of either table are ignored.
    """
    rows = keep(document_statistics(docs), "statistics")
    named = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows.filter(learn).join(named, "doc_id").select("x", "y")))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(_matrix(b.column("x"))))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are runs of letters and digits between boundary marks; their subwords are the runs of 3 to 6
bytes, hashed into ``BUCKETS`` embeddings. A misspelled word shares most subwords with the known one.
A passage of ``PASSAGE`` words is the mean of its subword embeddings, the softmax scores passages, and
a text is as toxic as its most toxic passage, so that long texts do not dilute a few words.

Training reads at most ``sample`` texts of each label (``SAMPLE`` unless given), chosen by a hash of the id. Embeddings and softmax start on all passages with their text's label, then follow the most
toxic passage of each text. A logistic curve on the scores of sampled texts left out of that, weighted
by the labels' true shares over all labelled rows, makes them probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm import textkit as tk

BUCKETS = 1 << 17
DIMENSIONS = 8
LENGTHS = (3, 4, 5, 6)
PASSAGE = 3
SAMPLE = 2000
#: Every so many-th sampled text serves the calibration alone.
CALIBRATE = 5
ROUNDS = (3, 6)
BATCH = 512
#: Learning rates of the softmax and of the embeddings (scaled by past gradients), and the softmax's first size:
#: a passage is a mean of dozens of subwords, so a few of them must weigh much.
RATE = 0.2
STEP = 0.03
SCALE = 10.0
SEED = 11

_U = np.uint64
_MARK = 0x20


def subwords(column: pa.Array):
    """Yield ``(row, passage, bucket)`` arrays for pieces of a string column: every subword with the index of
    its text and of its passage (counted over the piece, from 0 and without gaps)."""
    data, offsets = tk.utf8(column)
    data = tk.lower_ascii(data)
    for a, b in tk.text_pieces(offsets, data, tk.PUNCTUATION):
        d = data[a:b]
        word = ~tk.PUNCTUATION[d]
        row = np.repeat(np.arange(len(offsets) - 1), np.clip(np.diff(np.clip(offsets, a, b)), 0, None))
        first = word.copy()
        first[1:] &= ~word[:-1] | (row[1:] != row[:-1])
        if not first.any():
            continue
        number = np.cumsum(first) - 1
        # one mark before each word and one behind the last: place of every word byte in the marked text
        at = np.flatnonzero(word)
        place = np.arange(len(at)) + number[at] + 1
        size = len(at) + int(number[at[-1]]) + 2
        marked = np.full(size, _MARK, np.uint8)
        marked[place] = d[at]
        word_of = np.zeros(size, np.int64)
        word_of[place] = number[at]
        begins = np.flatnonzero(first)
        row_of_word = row[begins]
        new_row = np.append(True, row_of_word[1:] != row_of_word[:-1])
        nth = np.arange(len(begins)) - np.maximum.accumulate(np.where(new_row, np.arange(len(begins)), 0))
        passage_of_word = np.cumsum((nth % PASSAGE == 0)) - 1
        is_mark = marked == _MARK
        # a mark belongs to the word that follows
        word_of[:-1] = np.where(is_mark[:-1], word_of[1:], word_of[:-1])
        values = tk.BYTE_VALUES[marked]
        values = values + is_mark.astype(_U) * _U(0x5851F42D4C957F2D)
        out = []
        inner = np.zeros(size, np.int64)
        inner[1:] = np.cumsum(is_mark)[:-1]  # marks before each place
        marks = np.append(inner, inner[-1] + is_mark[-1])
        for n in LENGTHS:
            if size < n:
                continue
            h = np.zeros(size - n + 1, _U)
            for j in range(n):
                h = h * _U(0x9E3779B97F4A7C15) + values[j: size - n + 1 + j]
            # no mark strictly inside
            ok = marks[n - 1: size] - marks[1: size - n + 2] == 0
            i = np.flatnonzero(ok)
            out.append((i, (tk.mix(h[i]) & _U(BUCKETS - 1)).astype(np.int32)))
        if not out:
            continue
        i = np.concatenate([x for x, _ in out])
        bucket = np.concatenate([x for _, x in out])
        order = np.argsort(i, kind="stable")
        w = word_of[i[order]]
        yield row_of_word[w], passage_of_word[w], bucket[order]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logits(self, column: pa.Array) -> np.ndarray:
        """The largest passage logit of each text; texts without a subword get the bias alone."""
        top = np.full(len(column), -np.inf)
        for row, passage, bucket in subwords(column):
            begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            mean = np.add.reduceat(self.weights[bucket], begin) / np.diff(np.append(begin, len(bucket)))
            np.maximum.at(top, row[begin], mean + self.bias)
        return np.where(np.isfinite(top), top, min(self.bias, 0.0))

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(column) + self.shift, -30, 30)))


def _passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All subword buckets, where each passage begins (with the end), and the text of each passage."""
    rows, begins, buckets, done = [], [], [], 0
    for row, passage, bucket in subwords(pa.array(texts, pa.string())):
        begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        rows.append(row[begin])
        begins.append(begin + done)
        buckets.append(bucket)
        done += len(bucket)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(buckets, np.int32), np.append(join(begins, np.int64), done), join(rows, np.int64)


def train(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Model from sampled texts; ``share`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(SEED)
    fitted = np.flatnonzero(np.arange(len(texts)) % CALIBRATE != 0)
    all_texts, all_labels = texts, labels
    texts, labels = [texts[i] for i in fitted], labels[fitted]
    buckets, begin, text = _passages(texts)
    emb = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, SCALE, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = np.full(BUCKETS, 1e-10, np.float32)
    length = np.diff(begin)

    def step(batch):
        nonlocal soft, bias
        parts = [buckets[begin[p]: begin[p + 1]] for p in batch]
        ids, n = np.concatenate(parts), length[batch]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        x = np.add.reduceat(emb[ids], starts) / n[:, None]
        z = x @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = labels[text[batch]]
        p[np.arange(len(batch)), y] -= 1
        p *= weight[y][:, None] / len(batch)
        to_x = (p @ soft.T) / n[:, None]
        soft -= RATE * (x.T @ p)
        bias -= RATE * p.sum(0)
        used, where = np.unique(ids, return_inverse=True)
        of = np.repeat(np.arange(len(batch)), n)
        grad = np.stack([np.bincount(where, to_x[of, k], len(used)) for k in range(DIMENSIONS)], 1)
        squares[used] += (grad * grad).mean(1)
        emb[used] -= (STEP * grad / np.sqrt(squares[used])[:, None]).astype(np.float32)

    everything = np.arange(len(text))
    for kind, rounds in enumerate(ROUNDS):
        for _ in range(rounds):
            chosen = everything
            if kind:
                scalar = emb @ (soft[:, 1] - soft[:, 0])
                logit = np.add.reduceat(scalar[buckets], begin[:-1]) / length if len(text) else length
                order = np.lexsort((-logit, text))
                chosen = order[np.append(True, text[order][1:] != text[order][:-1])]
            counts = np.bincount(labels[text[chosen]], minlength=2)
            weight = counts.sum() / np.maximum(2 * counts, 1)
            chosen = rng.permutation(chosen)
            for a in range(0, len(chosen), BATCH):
                step(chosen[a: a + BATCH])
    model = Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    # logistic curve on the scores of the texts left out, by Newton steps
    rest = [i for i in range(0, len(all_texts), CALIBRATE)]
    x, labels = model.logits(pa.array([all_texts[i] for i in rest], pa.string())), all_labels[rest]
    n1 = max(1, labels.sum())
    w = np.where(labels == 1, share / n1, (1 - share) / max(1, len(labels) - n1))
    a = np.column_stack([x, np.ones(len(x))])
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2) * w.sum()
        theta = theta - np.clip(np.linalg.solve(h, a.T @ (w * (p - labels)) + 1e-4 * w.sum() * (theta - [1, 0])), -2, 2)
    model.slope, model.shift = max(0.0, float(theta[0])), float(theta[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: str, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` texts of each label among the labelled rows of ``docs (doc_id, text)`` whose ``doc_id`` satisfies ``learn``."""
    named = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(learn)
    shares = {r.toxic: r["count"] for r in named.groupBy("toxic").count().collect()}  # two rows
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = named.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(named.filter("toxic = 0").orderBy(*order).limit(sample))
    # at most 2 * sample ids: small enough to be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    if not {r.toxic for r in rows} >= {0, 1}:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, -30.0 if shares.get(0) else 0.0)
    return train([r.text for r in rows], np.array([r.toxic for r in rows]), shares[1] / (shares[0] + shares[1]))


def classify(docs: DataFrame, labels: DataFrame, learn: str, sample: int = SAMPLE) -> DataFrame:
    """``docs (doc_id, text)``, ``labels (doc_id, toxic)`` -> ``(doc_id, score)``, one row for each row of ``docs``.

    Null labels count as absent; of several labels of a document the largest counts. A null text
    scores like an empty one. Without labels of both kinds every score is the same. Further columns of
    either table are ignored. Texts are scored whole, a long one piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, sample))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

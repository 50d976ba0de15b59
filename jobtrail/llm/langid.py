"""Language identification with interpolated Kneser-Ney character models.

One model per language over characters: letters in lower case, every run of other characters
one space. Counts of ``ORDER``-grams are gathered from every training text by Spark; lower orders
use continuation counts (in how many contexts an n-gram occurs). Spark counts the n-grams and the contexts of
every order, all of them; the tables are cut by a hash into blocks of about ``BLOCK_ROWS`` rows, sorted and broadcast
one by one. A task looks up its distinct n-grams in one block after the other, so neither the driver nor a
task holds more than a block, however large the model is. A text gets
the language of lowest cross-entropy per character; it is rejected when that cross-entropy is
far above what training texts of the language have at that length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.llm import textkit as tk
from jobtrail.llm.tables import keep

ORDER = 4
#: Bits of a character in a packed context; every code point fits, and three fit into a long.
BITS = 21
#: Rows of a model table that are collected, broadcast and looked up at once.
BLOCK_ROWS = 1 << 20
#: Longer texts are cut before a character that is no letter.
SEGMENT = 1 << 20
#: Characters gathered before their n-grams are formed; a longer segment is handled alone.
PIECE = 1 << 18
#: A text is rejected when its cross-entropy is ``LEAST_EXCESS`` bits above the mean and its scaled excess above
#: ``SLACK`` times the 99.9th percentile.
SLACK = 3.0
LEAST_EXCESS = 0.5
SCALE_CHARS = 400
CACHE = 1 << 20

_SPACE = 32
_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[points]


def _segments(text: str):
    a = 0
    while len(text) - a > SEGMENT:
        b = a + SEGMENT
        while b < len(text) and text[b].isalpha():
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def grams(texts: list[str | None]):
    """Yield ``(context, letter, owner)`` pieces: the ``ORDER``-grams of the texts in order, each as its packed leading
    characters (``BITS`` a character) and its last one, and the index of its text."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for s in _segments((text or "").lower()):
            held.append((i, s))
            size += len(s)
            if size >= PIECE:
                yield _pack(held)
                held, size = [], 0
    if held:
        yield _pack(held)


def _pack(held):
    points = np.frombuffer("".join(s for _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
    letter = _is_letter(points)
    use = letter.copy()
    use[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    code = np.where(letter, points, _SPACE)[use].astype(np.int64)
    owner = owner[use]
    lead = ORDER - 1
    at = np.arange(len(code)) + lead * (owner + 1)
    padded = np.full(len(code) + lead * len(held), _SPACE, np.int64)
    padded[at] = code
    context = np.zeros(len(code), np.int64)
    for back in range(1, ORDER):
        context |= padded[at - back] << (BITS * (back - 1))
    return context, code, np.array([i for i, _ in held])[owner]


def _distinct(context: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram its index among the distinct ones, and those."""
    of, contexts = pd.factorize(context)
    ids, keys = pd.factorize(of << BITS | letter)
    return ids, contexts[keys >> BITS], keys & ((1 << BITS) - 1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, text)`` -> ``(lang, context, letter, n)`` over all rows with a language."""

    def run(batches):
        for b in tk.slices(batches):
            lang = pd.Categorical(b.column("lang").to_pylist())
            for context, letter, owner in grams(b.column("text").to_pylist()):
                ids, contexts, letters = _distinct(context, letter)
                which, pairs = pd.factorize(ids * len(lang.categories) + lang.codes[owner])
                gram, of = np.divmod(pairs, max(1, len(lang.categories)))
                names = pa.array(lang.categories, pa.string()).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([names, pa.array(contexts[gram]), pa.array(letters[gram].astype(np.int32)), pa.array(np.bincount(which, minlength=len(pairs)))], ["lang", "context", "letter", "n"])

    return (docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(tk.tidy(run), "lang string, context long, letter int, n long")
            .groupBy("lang", "context", "letter").agg(F.sum("n").alias("n")))


class Keys:
    """Places of ``(context, letter)`` pairs in a sorted table of them."""

    def __init__(self, context: np.ndarray, letter: np.ndarray):
        self.contexts, of = np.unique(context, return_inverse=True)
        keys = of.astype(np.int64) << BITS | letter
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, context: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the first row that holds it and the row behind the last (the same if none does)."""
        if not len(self.keys):
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        key = np.where(self.contexts[at] == context, at.astype(np.int64) << BITS | letter, -1)
        return np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")


class Block:
    """A block of a model table: ``(context, letter, language)`` rows, sorted, and their values."""

    def __init__(self, table: pa.Table, names: list[str], values: list[str]):
        column = lambda c: table.column(c).to_numpy()
        self.rows = Keys(column("context"), column("letter"))
        self.lang = pd.Categorical(table.column("lang").to_pylist(), categories=names).codes[self.rows.order].astype(np.int32)
        self.values = [column(v)[self.rows.order] for v in values]

    def fill(self, context: np.ndarray, letter: np.ndarray, out: list[np.ndarray]) -> None:
        """Put the values of the n-grams found here into ``out``, ``(n-grams, languages)`` each."""
        first, end = self.rows.find(context, letter)
        n = end - first
        row = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        gram = np.repeat(np.arange(len(n)), n)
        for values, target in zip(self.values, out):
            target[gram, self.lang[row]] = values[row]


def _blocks(table: DataFrame, names: list[str], values: list[str]) -> list:
    """A kept ``(lang, context, letter, *values)`` table as broadcast blocks."""
    spark = table.sparkSession
    blocks = max(1, -(-table.count() // BLOCK_ROWS))
    if blocks > 1:  # each block reads its own files
        table = keep(table.withColumn("block", F.expr(f"int(pmod(xxhash64(context, letter), {blocks}))")), "blocks", by="block")
    part = lambda k: table.filter(F.col("block") == k) if blocks > 1 else table
    return [spark.sparkContext.broadcast(Block(part(k).toArrow(), names, values)) for k in range(blocks)]


def _load(shared) -> Block:
    """The block of a broadcast; the worker's reference to it goes, so that one block at a time is in memory."""
    block = shared.value
    vars(shared).pop("_value", None)
    return block


class KneserNey:
    """Interpolated Kneser-Ney models of all languages: for each order, highest first, its length, the discount of each
    language, and blocks of the counts and of the contexts (total count and number of distinct letters)."""

    def __init__(self, names: list[str], alphabet: int, orders: list[tuple]):
        self.names, self.base, self.orders = names, 1.0 / (alphabet + 1), orders

    def log2p(self, context: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """``(n-grams, languages)``."""
        shape = len(context), len(self.names)
        p = np.full(shape, self.base)
        for order, discount, seen, contexts in reversed(self.orders):
            lead = context & ((1 << (BITS * (order - 1))) - 1)
            n, total, follow = np.zeros(shape), np.zeros(shape), np.zeros(shape)
            for shared in seen:
                _load(shared).fill(lead, letter, [n])
            for shared in contexts:
                _load(shared).fill(lead, np.zeros_like(letter), [total, follow])
            some = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(n - discount, 0) / some + discount * follow / some * p, p)
        return np.log2(p)


def train(docs: DataFrame) -> KneserNey:
    """A model for each distinct non-null ``lang`` of ``docs (lang, text)``; languages without a letter get none."""
    counts = keep(gram_counts(docs), "grams")
    names, orders, alphabet = [], [], 0
    for order in range(ORDER, 0, -1):
        few = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
        few = {r.lang: (r.n1, r.n2) for r in few}
        names = sorted(few)
        if not names:
            break
        discount = np.array([min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.1)) for n1, n2 in map(few.get, names)])
        contexts = keep(counts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("follow")).withColumn("letter", F.lit(0)), "contexts")
        orders.append((order, discount, _blocks(counts, names, ["n"]), _blocks(contexts, names, ["total", "follow"])))
        if order == 1:
            alphabet = counts.select("letter").distinct().count()
        else:  # continuation counts of the next lower order
            suffix = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1))
            counts = keep(counts.groupBy("lang", suffix.alias("context"), "letter").agg(F.count("*").alias("n")), "grams")
    return KneserNey(names, alphabet, orders)


def cross_entropies(docs: DataFrame, models: KneserNey, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``chars`` (scored characters), ``lang_pred`` (lowest cross-entropy;
    ties: first by name; ``und`` without letters or models), ``entropy`` (bits per character) and
    ``score`` (its share among the languages over ``64`` characters at most)."""
    names = models.names

    def run(batches):
        none = np.zeros(0, np.int64)
        known, table = Keys(none, none), np.zeros((0, len(names)))
        contexts, letters = none, none
        for b in tk.slices(batches):
            n = b.num_rows
            chars, sums = np.zeros(n, np.int64), np.zeros((n, len(names)))
            for context, letter, owner in grams(b.column("text").to_pylist()) if names else ():
                ids, context, letter = _distinct(context, letter)
                first, end = known.find(context, letter)
                fresh = np.flatnonzero(first == end)
                if len(fresh):
                    if len(contexts) > CACHE:
                        contexts, letters, table, fresh = none, none, table[:0], np.arange(len(context))
                    contexts, letters = np.concatenate([contexts, context[fresh]]), np.concatenate([letters, letter[fresh]])
                    table = np.concatenate([table, models.log2p(context[fresh], letter[fresh])])
                    known = Keys(contexts, letters)
                    first, _ = known.find(context, letter)
                values = table[known.order[first]]
                chars += np.bincount(owner, minlength=n)
                for c in range(len(names)):
                    sums[:, c] += np.bincount(owner, values[ids, c], minlength=n)
            some = chars > 0
            entropy = -sums / np.maximum(chars, 1)[:, None]
            best = entropy.argmin(1) if names else np.zeros(n, int)
            low = entropy[np.arange(n), best] if names else np.zeros(n)
            score = 1 / np.exp2(-np.minimum(chars, 64)[:, None] * (entropy - low[:, None])).sum(1) if names else np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in columns), pa.array(chars), pa.array([names[i] if s else "und" for i, s in zip(best, some)]), pa.array(np.where(some, low, 0.0)), pa.array(np.where(some, score, 0.0))],
                [*columns, "chars", "lang_pred", "entropy", "score"])

    scores = T.StructType().add("chars", "long").add("lang_pred", "string").add("entropy", "double").add("score", "double")
    return docs.select(*columns, "text").mapInArrow(tk.tidy(run), T.StructType([docs.schema[x] for x in columns] + scores.fields))


def identify(docs: DataFrame, learn: str, columns: list[str]) -> DataFrame:
    """Train on the rows of ``docs (lang, text, ...)`` that satisfy ``learn``, then score all rows.

    Adds ``rejected``: true for texts without a letter and for those whose cross-entropy
    exceeds the language's mean by more than ``LEAST_EXCESS`` and by more than ``SLACK`` times what 99.9 % of its
    training texts do, the excess being scaled by ``sqrt(min(chars, SCALE_CHARS))`` since short texts vary more.
    A null ``learn`` counts as false. Repeated rows come out as often as they come in; an empty table
    gives an empty table; without any training row every text is ``und`` and rejected.
    """
    learn_ = F.coalesce(F.expr(learn), F.lit(False))
    models = train(docs.filter(learn_))
    scored = keep(cross_entropies(docs.withColumns({"_learn": learn_ & F.col("lang").isNotNull(), "_own": F.col("lang")}), models, [*columns, "_learn", "_own"]), "language-scores")
    own = scored.filter("_learn and lang_pred = _own and chars > 0")
    mean = own.groupBy("lang_pred").agg((F.sum(F.col("entropy") * F.col("chars")) / F.sum("chars")).alias("_mean"))
    means = F.broadcast(mean)  # one row for each model
    excess = (F.col("entropy") - F.col("_mean")) * F.sqrt(F.least("chars", F.lit(SCALE_CHARS)))
    limit = own.join(means, "lang_pred").groupBy("lang_pred").agg(F.max("_mean").alias("_mean"), F.percentile_approx(excess, 0.999, 10000).alias("_limit"))
    return (scored.join(F.broadcast(limit), "lang_pred", "left")
            .withColumn("rejected", F.coalesce((excess > SLACK * F.greatest("_limit", F.lit(0.0))) & (F.col("entropy") - F.col("_mean") > LEAST_EXCESS), F.lit(True)))
            .select(*columns, "lang_pred", "score", "entropy", "chars", "rejected"))

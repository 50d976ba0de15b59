"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of any script in lower case; in scripts written without spaces every character
is a word. Running hashes of ``min_match`` words of every
text are looked up among those of the benchmark items (the shared-token seeds); seeds on one
diagonal join into maximal matches; the longest match is marked again and again, and what overlaps
marked words is trimmed, until no unmarked match of ``min_match`` words is left. Tiles may come in any
order, so a passage whose sentences were swapped is still covered. A text is contaminated
by an item when tiles cover at least ``min_coverage`` of the item's words. An item of fewer than ``min_match`` words is
one seed of its own length: a text that holds it anywhere holds it whole.

The benchmark's seeds go to the tasks in blocks of at most ``BLOCK_WORDS`` words (one pass over the
texts for each block), so what is broadcast is bounded however large the benchmark is. Texts are
not shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm import textkit as tk

BLOCK_WORDS = 2_000_000
#: Texts of a batch that are looked at together.
SLICE = 1024
#: Pairs of places (text, item) that are laid out at once; matches above which superfluous ones are dropped.
_PAIRS = 1 << 21

#: Scripts written without spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def plain_words(text: Column) -> Column:
    """``text`` in lower case; where it has other than ASCII characters, words are parted by spaces."""
    low = F.lower(text)
    single = "[" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "]"
    parted = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}]+", " "), f"({single})", " $1 ")
    return F.when(low.rlike(r"[^\x00-\x7f]"), parted).otherwise(low)


class Seeds:
    """Seed hashes of a block of benchmark items, sorted, with the places where each occurs."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        data, offsets = tk.utf8(pa.array([t for _, t in items], pa.string()))
        words, bounds = tk.word_hashes(data, offsets, tk.PUNCTUATION)
        self.ids = [i for i, _ in items]
        self.min_match = min_match
        self.words = np.diff(bounds)
        hashes, item, place = [], [], []
        for i in np.flatnonzero(self.words >= min_match):
            s, _ = tk.shingle_hashes(words[bounds[i]: bounds[i + 1]], np.array([0, self.words[i]]), min_match)
            hashes.append(s)
            item.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        hashes = join(hashes, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = join(item, np.int64)[order], join(place, np.int64)[order]
        self.hashes, self.start = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(order)))
        #: For each length below ``min_match``: the hashes of the items of that length, and the items of each.
        self.short = []
        for n in np.unique(self.words[(self.words > 0) & (self.words < min_match)]):
            items_ = np.flatnonzero(self.words == n)
            whole = np.concatenate([tk.shingle_hashes(words[bounds[i]: bounds[i + 1]], np.array([0, n]), int(n))[0] for i in items_])
            distinct, of = np.unique(whole, return_inverse=True)
            self.short.append((int(n), distinct, [items_[of == k] for k in range(len(distinct))]))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """``(row, item, matched words)`` of every text and item that share a seed."""
        if not len(self.hashes) and not self.short:
            return
        words, bounds = tk.word_hashes(*tk.utf8(column), tk.PUNCTUATION)
        for n, distinct, items in self.short:
            runs, at = tk.shingle_hashes(words, bounds, n)
            found = np.minimum(np.searchsorted(distinct, runs), len(distinct) - 1)
            hit = np.flatnonzero(distinct[found] == runs)
            rows = np.searchsorted(at, hit, side="right") - 1
            whole = np.diff(bounds)[rows] >= n
            for pair in np.unique(rows[whole] * len(distinct) + found[hit[whole]]):
                for i in items[pair % len(distinct)]:
                    yield int(pair // len(distinct)), int(i), n
        if not len(self.hashes):
            return
        runs, at = tk.shingle_hashes(words, bounds, self.min_match)
        found = np.searchsorted(self.hashes, runs)
        found[found == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[found] == runs)
        rows = np.searchsorted(at, hit, side="right") - 1
        whole = np.diff(bounds)[rows] >= self.min_match
        hit, rows = hit[whole], rows[whole]
        found = found[hit]
        # texts whose pairs fit are laid out together, any other one by itself
        begin = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows)) if len(rows) else np.zeros(1, np.int64)
        pairs = np.concatenate([[0], np.cumsum(self.count[found])])[begin]
        x = 0
        while x < len(begin) - 1:
            y = max(x + 1, int(np.searchsorted(pairs, pairs[x] + _PAIRS, side="right")) - 1)
            part = slice(begin[x], begin[y])
            if pairs[y] - pairs[x] <= _PAIRS:
                yield from self._laid_out(hit[part], rows[part], found[part], at)
            else:
                yield from self._one_text(hit[part] - at[rows[part]], int(rows[begin[x]]), found[part])
            x = y

    def _laid_out(self, hit, rows, found, at) -> Iterator[tuple[int, int, int]]:
        """All pairs of places of some texts, by text and item."""
        n = self.count[found]
        entry = np.repeat(self.start[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        row, spot = np.repeat(rows, n), np.repeat(hit - at[rows], n)
        item, place = self.item[entry], self.place[entry]
        order = np.lexsort((place, spot - place, item, row))
        row, spot, item, place = row[order], spot[order], item[order], place[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else []
        for a, b in zip(new, [*new[1:], len(row)]):
            yield int(row[a]), int(item[a]), tile(*maximal(spot[a:b], place[a:b], self.min_match), int(self.words[item[a]]), self.min_match)

    def _one_text(self, spot, row, found) -> Iterator[tuple[int, int, int]]:
        """A text in which seeds are so frequent that its pairs are laid out item by item and by ranges of diagonals."""
        order = np.argsort(found, kind="stable")
        seeds, first = np.unique(found[order], return_index=True)
        spots = dict(zip(seeds.tolist(), np.split(spot[order], first[1:])))
        entries = np.concatenate([np.arange(self.start[s], self.start[s] + self.count[s]) for s in seeds])
        entries = entries[np.lexsort((self.place[entries], self.item[entries]))]
        seed_of = np.searchsorted(self.start, entries, side="right") - 1
        items, new = np.unique(self.item[entries], return_index=True)
        for item, lo, hi in zip(items.tolist(), new, [*new[1:], len(entries)]):
            places = [(int(self.place[e]), spots[int(s)]) for e, s in zip(entries[lo:hi], seed_of[lo:hi])]
            words = int(self.words[item])
            held = [np.zeros(0, np.int64)] * 3
            low = min(int(at[0]) - p for p, at in places)
            high = max(int(at[-1]) - p for p, at in places) + 1
            for d in range(low, high, max(1, _PAIRS // len(places))):
                e = min(high, d + max(1, _PAIRS // len(places)))
                cut = [(p, at[np.searchsorted(at, d + p): np.searchsorted(at, e + p)]) for p, at in places]
                s, p = np.concatenate([c for _, c in cut]), np.repeat([p for p, _ in cut], [len(c) for _, c in cut])
                if len(s):
                    o = np.lexsort((p, s - p))
                    held = [np.concatenate(h) for h in zip(held, maximal(s[o], p[o], self.min_match))]
                    if len(held[0]) > _PAIRS:
                        held = needed(*held, words, self.min_match)
            yield row, item, tile(*held, words, self.min_match)


def maximal(spot: np.ndarray, place: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(length, place, spot)`` of the maximal matches. ``spot`` and ``place``: where seeds of ``min_match`` words
    occur in the text and in the item, ordered by diagonal (``spot - place``) and place."""
    begin = np.flatnonzero(np.append(True, (np.diff(spot - place) != 0) | (np.diff(place) != 1)))
    return np.diff(np.append(begin, len(spot))) + min_match - 1, place[begin], spot[begin]


def needed(length: np.ndarray, place: np.ndarray, spot: np.ndarray, words: int, min_match: int) -> list[np.ndarray]:
    """Of matches that differ in their spot only, the first so many that one of them is always free.

    Tiles take ``words`` words of the text at most, in ``words / min_match`` tiles, and a tile of ``n`` words is in the way of
    fewer than ``n + length`` spots; further spots therefore change no tile.
    """
    most = 2 + words + (words // min_match + 1) * words
    order = np.lexsort((spot, length, place))
    length, place, spot = length[order], place[order], spot[order]
    first = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(length) != 0)))
    rank = np.arange(len(spot)) - np.repeat(first, np.diff(np.append(first, len(spot))))
    return [x[rank < most] for x in (length, place, spot)]


def tile(length: np.ndarray, place: np.ndarray, spot: np.ndarray, words: int, min_match: int) -> int:
    """Words of an item of ``words`` words that greedy tiles cover: the longest match (the first place and spot
    of equals) is marked, and what is left of the others is looked at again. Ends when no match can be left."""
    order = np.lexsort((spot, place, -length))
    later: list[tuple[int, int, int]] = []  # what trimming has left, as a heap
    in_text: set[int] = set()
    in_item: set[int] = set()
    i = 0
    while i < len(order) or later:
        k = order[i] if i < len(order) else None
        head = (-int(length[k]), int(place[k]), int(spot[k])) if k is not None else None
        if later and (head is None or later[0] < head):
            n, p, s = heapq.heappop(later)
        else:
            n, p, s = head
            i += 1
        free, run, longest = -n, 0, []
        for j in range(free + 1):
            if j < free and p + j not in in_item and s + j not in in_text:
                run += 1
                continue
            if run >= min_match:
                longest.append((run, j - run))
            run = 0
        if longest and longest[0][0] == free:
            in_item.update(range(p, p + free))
            in_text.update(range(s, s + free))
            if not _room(in_item, words, min_match):
                break
        else:
            for run, j in longest:
                heapq.heappush(later, (-run, p + j, s + j))
    return len(in_item)


def _room(in_item: set[int], words: int, min_match: int) -> bool:
    """Whether ``min_match`` words in a row are unmarked."""
    run = 0
    for w in range(words):
        run = 0 if w in in_item else run + 1
        if run >= min_match:
            return True
    return False


def _blocks(benchmark: DataFrame, min_match: int) -> Iterator[Seeds]:
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        part = items.filter(F.expr(f"pmod(xxhash64(text), {blocks}) = {k}")) if blocks > 1 else items
        yield Seeds([tuple(r) for r in part.orderBy("item_id", "text").collect()], min_match)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.6) -> DataFrame:
    """``docs (doc_id, text)`` x ``benchmark (item_id, text)`` -> ``(doc_id, item_id, matched_words, item_words,
    coverage)`` for each text and item that it contains to ``min_coverage``.

    Null texts and texts or items without a word match nothing; an item of fewer than ``min_match`` words is matched
    as a whole, longer items match no text of fewer words than that. Repeated rows
    and repeated items are reported as often as they come in; a null id is reported as null. Empty tables
    give an empty table; further columns are ignored.
    """
    schema = "doc_id long, item_id long, matched_words long, item_words long, coverage double"
    out = docs.sparkSession.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_words(F.col("text")).alias("text"))
    for seeds in _blocks(benchmark, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            index = shared.value
            for b in tk.slices(batches, SLICE):
                ids = b.column("doc_id")
                got = [(ids[r].as_py(), index.ids[i], n, int(index.words[i]), n / int(index.words[i])) for r, i, n in index.matches(b.column("text"))]
                got = [x for x in got if x[4] >= min_coverage]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "matched_words", "item_words", "coverage"])

        out = out.unionByName(texts.mapInArrow(tk.tidy(run), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs`` (all columns, any names beside ``text``) that no benchmark item contaminates. Null and empty
    texts stay. Only the text's words go to the Python workers; the rows stay where they are."""
    out = docs
    for seeds in _blocks(benchmark, min_match):
        clean = F.arrow_udf(_clean(docs.sparkSession.sparkContext.broadcast(seeds), min_coverage), "boolean")
        out = out.filter(clean(plain_words(F.col("text"))))
    return out


def _clean(shared: Broadcast, min_coverage: float) -> Callable:
    """For each text of Arrow arrays whether no item of the seeds ``shared`` is covered."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        try:
            for text in texts:
                clean = np.ones(len(text), bool)
                for lo in range(0, len(text), SLICE):
                    for r, i, n in index.matches(text.slice(lo, SLICE)):
                        clean[lo + r] &= n / int(index.words[i]) < min_coverage
                yield pa.array(clean)
        finally:
            tk.release()

    return run

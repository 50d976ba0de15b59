"""Fill-in-middle transformation with memoized content-defined chunks.

A text is cut into units (lines) at two drawn places into prefix, middle and suffix, which are put in another order
behind marks. To find the places, a rolling hash cuts each text into chunks where its content says so (the hash of the
last ``WINDOW`` bytes has its upper bits zero), so that passages which many texts share fall into the same chunks
whatever stands before them. A chunk's summary (line ends, characters) is looked up in a cache by the chunk's whole
content, so equal hashes of different chunks cannot mix, and counted only when it is new. Sums of the summaries give
the number of units and say in which chunk a cut lies; only that chunk is read again.

The cache belongs to a task, is bounded by ``CACHE_BYTES`` and starts afresh when full: it changes the cost, never a
result. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes the rolling hash looks at, bits of it that are zero at a cut (2**BITS bytes a chunk on average), longest chunk.
WINDOW, BITS, LONGEST = 48, 11, 1 << 15
#: Content a task's cache holds at most.
CACHE_BYTES = 32 << 20
#: Bytes hashed at once, and bytes of output in one Arrow batch.
_PIECE, _OUT = 1 << 20, 8 << 20

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_U = np.uint64
_rng = np.random.default_rng(13)
_GEAR = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)
_BASE = _U(0x5851F42D4C957F2D)
_POWER = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_PIECE + WINDOW, _BASE)]), dtype=_U)
_INVERSE = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_PIECE + WINDOW, _U(pow(int(_BASE), -1, 1 << 64)))]), dtype=_U)
#: UTF-8 bytes that continue a character.
_CONTINUED = bytes(range(0x80, 0xC0))


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text. A cut depends on the ``WINDOW`` bytes before it alone; where none comes for
    ``LONGEST`` bytes, one is made."""
    found = []
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, max(0, len(raw) - WINDOW + 1), _PIECE):
        piece = raw[lo: lo + _PIECE + WINDOW - 1]
        run = np.concatenate([np.zeros(1, _U), np.cumsum(_GEAR[piece] * _POWER[: len(piece)], dtype=_U)])
        rolled = (run[WINDOW:] - run[:-WINDOW]) * _INVERSE[: len(run) - WINDOW]
        found.append(np.flatnonzero(rolled >> _U(64 - BITS) == 0) + lo + WINDOW)
    ends, at = [], 0
    for end in [*(np.concatenate(found).tolist() if found else []), len(data)]:
        while end - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if end > at:
            ends.append(end)
            at = end
    return ends


def _summary(chunk: bytes) -> tuple[int, int]:
    """Line ends and characters of a chunk; both add up over chunks, also where a chunk ends within a character."""
    return chunk.count(b"\n"), len(chunk.translate(None, _CONTINUED))


class Memo:
    """Summaries of chunks by content, at most ``limit`` bytes of it."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.known, self.hits = limit, 0, {}, 0

    def __call__(self, chunk: bytes) -> tuple[int, int]:
        got = self.known.get(chunk)  # equal content, not only an equal hash
        if got is not None:
            self.hits += 1
            return got
        if self.held + len(chunk) > self.limit:
            self.known, self.held = {}, 0
        got = self.known[chunk] = _summary(chunk)
        self.held += len(chunk)
        return got


class Units:
    """The lines of a text, known through the summaries of its chunks."""

    def __init__(self, data: bytes, memo: Memo):
        self.data, self.ends = data, chunk_ends(data)
        starts = [0, *self.ends]
        counts = [memo(data[a:b]) for a, b in zip(starts, self.ends)]
        self.lines = np.cumsum([0, *(c[0] for c in counts)])
        self.chars = np.cumsum([0, *(c[1] for c in counts)])
        self.n = int(self.lines[-1]) + (1 if data and not data.endswith(b"\n") else 0)

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and character offset behind the first ``k`` units."""
        if k == 0:
            return 0, 0
        if k > self.lines[-1]:
            return len(self.data), int(self.chars[-1])
        i = int(np.searchsorted(self.lines, k)) - 1  # the chunk that holds the k-th line end
        start = self.ends[i - 1] if i else 0
        chunk = np.frombuffer(self.data[start: self.ends[i]], np.uint8)
        at = int(np.flatnonzero(chunk == 10)[k - int(self.lines[i]) - 1]) + 1
        return start + at, int(self.chars[i]) + _summary(chunk[:at].tobytes())[1]


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]


def rearranged(doc_id: int | None, text: str | None, memo: Memo, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    data = (text or "").encode()
    units = Units(data, memo)
    h1, h2, h3, h4 = _draws(doc_id, seed)
    p, s, m = (x.encode() for x in MARKS)
    if not data or p in data or s in data or m in data or h3 % 100 >= percent:
        return units.n, "plain", None, None, data
    x, y = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    (a, prefix_chars), (b, chars) = units.cut(x), units.cut(y)
    if h4 % 100 < spm_percent:
        return units.n, "spm", prefix_chars, chars - prefix_chars, s + data[b:] + p + data[:a] + m + data[a:b]
    return units.n, "psm", prefix_chars, chars - prefix_chars, p + data[:a] + s + data[b:] + m + data[a:b]


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row for each row.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first; the draws are taken from
    the SHA-256 of ``seed:doc_id``, so reruns agree (a null id counts as an empty one, and repeated rows give equal
    results). A null or empty text and one that holds a mark stay as they are (form ``plain``, null lengths). Whole
    texts are read whatever their length, line by line nowhere. Further columns of ``docs`` are ignored.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        memo, rows, size = Memo(), [], 0

        def batch():
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *rearranged(doc_id, text.as_py(), memo, seed, percent, spm_percent)))
                size += len(rows[-1][-1])
                if size >= _OUT:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()
                rows, size = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. A rearranged output holds each mark once, since the text holds none."""
    part = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2]))
            .otherwise(F.concat(part[2], part[3], part[1])))


def digest(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests in place of the output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def fim_sql(seed: int = 7, percent: int = 100, spm_percent: int = 50) -> str:
    p, s, m = MARKS
    return rf"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {percent} THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
        ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM parts"""

"""Secret scan with structural confirmation.

Base kinds are patterns alone (``assign``, ``access``, ``hex``). Further candidates, base64 or hex
runs and dotted tokens, are reported only when what they decode to has the structure of a
secret: nested DER lengths that fit to the last byte in the shape of a key (``der``), length-prefixed
SSH key fields (``ssh``), or a signed token whose header and claims are JSON and whose header names an
algorithm (``token``). A base64 key is also read from each line that begins like one, over as many lines as
its own header states: lines may be short, indented or parted by a literal ``\\n``, and what follows the key does not count.

Each text is first tested for the byte runs that its patterns need; patterns run only where they can match.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.llm import textkit as tk

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "ssh", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]{4,})*)={0,2}(?![A-Za-z0-9+/=])")
#: Where a key may begin: at the first base64 character of a line or word, not at the letter of an escape.
_KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/\\])|(?<=\\)(?![nrt])|(?<=\\[nrt]))(?=M[A-P]|AAAA|b3Bl)(?=[A-Za-z0-9+/]{24})")
_LINE = re.compile(r"[A-Za-z0-9+/]+")
_BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\+r)?\\+n)(?:[ \t]|\\+t)*")
_PADDING = re.compile(r"={0,2}(?![A-Za-z0-9+/=])")
_HEX_PAIRS = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

#: The names of SSH key types.
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_SSH_PRIVATE = b"openssh-key-v1\x00"
#: Fields of a public key behind its type.
_SSH_FIELDS = dict(zip(_SSH_TYPES, (2, 4, 1, 2, 2, 2)))
#: Bytes that some ciphers put behind the last field of a private key file.
_SSH_TAG = 16

_MAX_DEPTH = 16


def _der_items(data: bytes, depth: int = 0) -> list | None:
    """The nested ``(tag, content)`` of DER bytes, or None when a length does not fit. The content of a
    constructed item is the list of its parts."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at: at + n], "big")
            if size < 0x80 or n > 1 and data[at] == 0:  # DER has the shortest form only
                return None
            at += n
        if at + size > len(data):
            return None
        content: bytes | list | None = data[at: at + size]
        if tag & 0x20:
            content = _der_items(content, depth + 1) if depth < _MAX_DEPTH else None
            if content is None:
                return None
        items.append((tag, content))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence in the shape of a private or public key."""
    items = _der_items(data) if data[:1] == b"\x30" else None
    if not items or len(items) != 1:
        return False
    parts = items[0][1]
    tags = [t for t, _ in parts]
    named = lambda i: tags[i] == 0x30 and parts[i][1] and parts[i][1][0][0] == 0x06  # noqa: E731  an algorithm by its identifier
    if len(tags) >= 3 and tags[0] == 0x02 and named(1) and tags[2] == 0x04:
        return True  # wrapped private key
    if len(tags) == 2 and named(0) and tags[1] == 0x03:
        return True  # public key
    if len(tags) >= 2 and tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and len(parts[1][1]) >= 16:
        return True  # elliptic-curve private key
    numbers = [c for t, c in parts if t == 0x02]
    return len(numbers) == len(tags) and len(tags) in (2, 6, 9) and max(map(len, numbers)) >= 32  # integers of a public or private key


def is_ssh_key(data: bytes) -> bool:
    """Whether bytes are length-prefixed fields that begin with an SSH key type, or a private key file."""
    if data.startswith(_SSH_PRIVATE):
        return len(_ssh_fields(data[len(_SSH_PRIVATE):], 3)) == 3
    fields = _ssh_fields(data)
    return len(fields) >= 2 and fields[0] in _SSH_TYPES


def _ssh_fields(data: bytes, most: int | None = None) -> list[bytes]:
    """The fields of ``data``, none if they do not fit; with ``most``, that many leading ones."""
    fields, at = [], 0
    while at < len(data) and (most is None or len(fields) < most):
        n = int.from_bytes(data[at: at + 4], "big")
        if at + 4 + n > len(data):
            return []
        fields.append(data[at + 4: at + 4 + n])
        at += 4 + n
    return fields


def is_signed_token(text: str) -> bool:
    """Whether the first two of three dotted base64url parts are JSON objects and the first names an algorithm."""
    try:
        header, claims = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in text.split(".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str)


def _decoded(text: str) -> bytes:
    body = "".join(text.split()).rstrip("=")
    if len(body) % 4 == 1:
        return b""
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _confirmed(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


class _Run:
    """Successive base64 lines, read once however many keys seem to begin in them."""

    def __init__(self, text: str, at: int):
        self.text, self.starts, self.ends = text, [], []
        line = _LINE.match(text, at)
        while line:
            self.starts.append(line.start())
            self.ends.append(line.end())
            gap = _BREAK.match(text, line.end())
            line = gap and _LINE.match(text, gap.end())
        #: Base64 characters up to the end of each line.
        self.upto = list(accumulate(e - s for s, e in zip(self.starts, self.ends)))
        self.end = self.ends[-1]


class _Key:
    """What begins at a place of a run. Bytes are decoded only where they are asked for."""

    def __init__(self, run: _Run, at: int):
        i = bisect_right(run.starts, at) - 1
        self.run, self.at = run, run.upto[i] - (run.ends[i] - at)

    def read(self, a: int, b: int) -> bytes | None:
        """Bytes ``a`` to ``b``, or None if the lines have fewer."""
        run, first, last = self.run, self.at + a // 3 * 4, self.at - (-b * 4 // 3)
        if last > run.upto[-1]:
            return None
        i, parts = bisect_right(run.upto, first), []
        while first < last:
            begin = run.ends[i] - (run.upto[i] - first)
            take = min(run.upto[i], last) - first
            parts.append(run.text[begin: begin + take])
            first, i = first + take, i + 1
        chars = "".join(parts)
        return base64.b64decode(chars + "=" * (-len(chars) % 4))[a % 3: a % 3 + b - a]

    def end_of(self, n: int) -> int | None:
        """Where the text of ``n`` bytes ends with its padding, or None if that is not the end of a line."""
        run, last = self.run, self.at - (-n * 4 // 3)
        i = bisect_left(run.upto, last)
        if i == len(run.upto) or run.upto[i] != last:
            return None
        padding = _PADDING.match(run.text, run.ends[i])
        return padding.end() if padding else None

    def past(self, at: int, fields: int) -> int | None:
        """The place behind that many length-prefixed fields from byte ``at`` on."""
        for _ in range(fields):
            head = self.read(at, at + 4)
            if head is None:
                return None
            at += 4 + int.from_bytes(head, "big")
        return at


def _stated(key: _Key) -> list[int]:
    """The sizes that the key which begins here may have by its own header."""
    head = key.read(0, len(_SSH_PRIVATE))
    if head is None:
        return []
    if head[0] == 0x30:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n > 4 or head[2 + n] not in (0x02, 0x30):  # keys begin with a number or an algorithm
            return []
        return [2 + n + int.from_bytes(head[2: 2 + n], "big") if n else 2 + head[1]]
    if head == _SSH_PRIVATE:
        at = key.past(len(head), 3)
        count = key.read(at, at + 4) if at is not None else None
        at = key.past(at + 4, 2) if count == b"\x00\x00\x00\x01" else None
        return [at, at + _SSH_TAG] if at is not None else []
    size = 4 + int.from_bytes(head[:4], "big")
    kind = key.read(4, size) if size <= 4 + max(map(len, _SSH_TYPES)) else b""
    at = key.past(size, _SSH_FIELDS[kind]) if kind in _SSH_FIELDS else None
    return [at] if at is not None else []


def _keys(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base64 keys whose lines end where their header says. A header whose size does not end at the end of a
    line costs a look-up, so texts full of such headers take time in proportion to their length."""
    spans, done, run = [], 0, None
    for m in _KEY_START.finditer(text):
        if m.start() < done:
            continue
        if run is None or m.start() >= run.end:
            run = _Run(text, m.start())
        key = _Key(run, m.start())
        for size in _stated(key):
            end = key.end_of(size)
            kind = _confirmed(key.read(0, size)) if end is not None else None
            if kind:
                spans.append((kind, m.start(), end))
                done = end
                break
    return spans


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all spans of a text, in code points, by start and then kind."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    spans += [("token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    keys = _keys(text)
    spans += keys
    begun = {start for _, start, _ in keys}
    for pattern, decode in ((_BASE64, _decoded), (_HEX_PAIRS, bytes.fromhex)):
        for m in pattern.finditer(text):
            kind = _confirmed(decode(m[0])) if m.start() not in begun else None
            if kind:
                spans.append((kind, *m.span()))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Byte classes and the run of them that a text must have for a pattern to match.
_NEEDS = ((_class(":="), 1), (_class(_UPPER + _DIGITS), 20), (_class(_DIGITS + "abcdef"), 24), (_class(_UPPER + _LOWER + _DIGITS + "+/"), 24), (_class(_UPPER + _LOWER + _DIGITS + "_-."), 38))


def _may_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a byte run that some pattern needs."""
    out = np.zeros(len(offsets) - 1, bool)
    for a in range(0, len(data), tk.PIECE):
        lo, d = max(0, a - 64), data[max(0, a - 64): a + tk.PIECE]
        for table, least in _NEEDS:
            edge = np.diff(np.concatenate([[0], table[d].view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long_ = end - begin >= least
            # a run may reach over the border of two texts: both are looked at
            first = np.searchsorted(offsets, begin[long_] + lo, side="right") - 1
            last = np.searchsorted(offsets, end[long_] + lo - 1, side="right") - 1
            for f, e in zip(first, last):
                out[f: e + 1] = True
    return out


def _scan_batch(column: pa.Array) -> list[list[tuple[str, int, int]]]:
    some = _may_match(*tk.utf8(column))
    return [scan_text(column[i].as_py()) if some[i] and column[i].is_valid else [] for i in range(len(column))]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, spans)``: for each row, its spans as ``(kind, start, end)`` by start, then kind
    in the order of ``KINDS``. Null and empty texts have none; repeated rows are scanned each; a null id stays null;
    further columns are ignored."""

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in _scan_batch(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tk.tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans and all spans as text, from the output of ``find_secrets``."""
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) of ``text`` replaced by ``mark``. All rows and columns stay."""

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = b.column(i)
            spans = _scan_batch(texts)
            if any(spans):
                out = []
                for t, found in zip(texts.to_pylist(), spans):
                    parts, at = [], 0
                    for _, start, end in found:
                        if start >= at:
                            parts += [t[at:start], mark]
                        at = max(at, end)
                    out.append("".join(parts) + t[at:] if found else t)
                b = b.set_column(i, b.schema.field(i), pa.array(out, texts.type))
            yield b

    return docs.mapInArrow(tk.tidy(run), T.StructType(docs.schema.fields))

"""SimHash near duplicates through deletion-variant signatures.

A text's fingerprint has a bit set where over half of the 64-bit hashes of its word shingles have it. Two
fingerprints link when at most ``RADIUS`` (two) bits differ. Cut into two segments of 32 bits, one segment of a linked
pair differs by at most one bit; so the segment's variants with one bit wiped out (32 for each segment) are indexed,
and linked fingerprints meet in an equality join on one of the 64 variants and are verified there.

* ``fingerprints``: one row per text, computed where the texts lie. Texts are never shuffled.
* ``links``: works on distinct fingerprints, so exact copies are one node. Variants held by one fingerprint only (nearly
  all) end in a count that is combined before the shuffle. Variants of up to ``CROWD`` fingerprints give their pairs.
  In a more crowded variant nothing is paired: its fingerprints are looked up by the 65 values within one bit of
  each. Two fingerprints at most two bits apart share such a value, and those that share one are at most two bits
  apart, so at most 65 fingerprints meet there and the link to the smallest of them stands for all.
* ``near_duplicates``: components of the links.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.components import components
from jobtrail.llm.tables import keep

#: Most differing bits of linked fingerprints; the two segments follow from it.
RADIUS = 2
#: Most fingerprints of a variant that are paired directly.
CROWD = 16
#: Shingles of a text that are hashed and counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text: XXH64 of its ``k``-word shingles (A-Z lowered, words parted by
    ASCII whitespace, joined by a space, repeats counted). Fewer words: all of them are one shingle; none: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - k + 1)
    last = ends[min(k, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):
        h = np.array([digest(joined[a: b - 1], seed) for a, b in zip(starts[lo: min(n, lo + _BLOCK)], last[lo: lo + _BLOCK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fingerprint long)``, one row for each row; the 64 bits as a signed number."""

    def run(batches):
        for b in batches:
            out = np.fromiter((fingerprint(t.as_py(), k, seed) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def _variants(nodes: DataFrame) -> DataFrame:
    """``(fingerprint)`` -> ``(fingerprint, variant)``: for each bit its segment without that bit, and the bit's number."""
    segment = "if(i < 32, fingerprint, shiftrightunsigned(fingerprint, 32)) & 4294967295"
    return nodes.select("fingerprint", F.explode(F.expr(
        f"transform(sequence(0, 63), i -> shiftleft(bigint(i), 32) | ({segment}) & ~shiftleft(bigint(1), i % 32))")).alias("variant"))


def _within_one(nodes: DataFrame) -> DataFrame:
    """``(fingerprint)`` -> ``(fingerprint, centre)``: the fingerprint itself and the 64 that differ by one bit."""
    return nodes.select("fingerprint", F.explode(F.expr(
        "concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(bigint(1), i)))")).alias("centre"))


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` that connect all pairs of the distinct, non-null fingerprints at most two bits apart."""
    # each fingerprint becomes 64 rows: dealt over all tasks before that, however few bytes they are
    rows = _variants(nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shared = rows.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes the 64 rows of a fingerprint for one and would broadcast them all: both sides are sorted instead
    held = keep(rows.hint("merge").join(shared, "variant"), "variants")
    met = held.filter(F.col("n") <= crowd).groupBy("variant").agg(F.sort_array(F.collect_list("fingerprint")).alias("f"))
    pairs = met.select(F.explode(F.expr("flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> struct(x as a, y as b))))")).alias("p")).select("p.*")
    pairs = pairs.filter(f"bit_count(a ^ b) <= {RADIUS}")
    crowded = held.filter(F.col("n") > crowd).select("fingerprint").distinct()
    near = _within_one(crowded).groupBy("centre").agg(F.collect_list("fingerprint").alias("f")).filter("size(f) > 1")
    stars = near.select(F.array_min("f").alias("a"), F.explode("f").alias("b")).filter("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest doc_id reachable by links, itself
    included. A null or empty text and one without words have fingerprint zero and link like any other. A row whose
    doc_id is null links with nothing (component null). Repeated rows come out as often as they come in; rows of one
    doc_id with different texts are linked through neither but stand for themselves. Texts of any length are read
    whole, in blocks of shingles. Further columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    found = keep(fingerprints(docs, k, seed), "fingerprints")
    nodes = found.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    label = components(links(nodes.select("fingerprint"), crowd)).withColumnRenamed("node", "fingerprint")
    named = nodes.join(label, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = keep(named.join(smallest, "component").select("fingerprint", "component_id"), "of-fingerprint")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.join(of, "fingerprint", "left").select(
        "doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

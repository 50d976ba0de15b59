"""Connected components of an edge table by rounds of min-label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.tables import forget, keep


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` -> ``(node, component)``: the smallest node reachable, for every node in an edge.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm
    of a component's size, not with its diameter, and no round gathers a component in one
    task. Each round is written to the shared folder and takes the place of the one before. Null ends and self-loops are ignored; an
    empty table gives an empty table.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    links = keep(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = None
    while True:
        # large-star: every neighbour above u is hung on the smallest node of u's neighbourhood
        sym = both(links)
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small-star: u and its smaller neighbours are hung on the smallest of them
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        before, links = links, keep(small, "links")
        forget(before)
        seen = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if seen == state:
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen

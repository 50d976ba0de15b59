"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Every source's documents are shuffled by a hash and laid end to end as one stream of words, cut into
blocks of equal size. Slots are numbered 0, 1, 2, ...; slot ``i`` stands at the point ``frac(i * 0.618...)`` of
the unit interval, which the sources' shares divide, so that every stretch of slots has nearly
the target mix. The slots of a source are ranked; the slot of rank ``r`` takes block ``r`` modulo the number
of blocks, up to ``MAX_REPEATS`` rounds.

No step gathers a source in one task: ranks and stream positions are sums over small groups
(chunks of slots, buckets of the hash) plus a count within the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.tables import keep

#: A source is taken at most so many times.
MAX_REPEATS = 3
#: Blocks that all sources together are cut into, about; a small source gets ``LEAST_SLOTS`` slots by smaller blocks.
SLOTS = 1 << 20
LEAST_SLOTS = 256
#: Fraction of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots in a chunk; cells of the unit interval; hash digits of a bucket of documents.
CHUNK = 4096
CELLS = 4096
BUCKET_DIGITS = 3
#: Most sources for which the table of sources is broadcast; beyond it Spark shuffles.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words of the text, 0 for null."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: ``sid`` (by code point, null last), ``source_size``, ``target``, ``block`` (words),
    ``blocks``, ``share`` (slots).

    Weights 1, 2, 3, repeating, share the sum of all sizes. With sources ordered by the level at
    which they are used up, the level of the others follows from sums before and after.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    per = per.withColumn("full", MAX_REPEATS * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full", "sid")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "used": F.coalesce(F.sum(MAX_REPEATS * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    per = per.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "sid", "level"))).over(everything)["level"])
    per = per.withColumn("target", F.least((MAX_REPEATS * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    per = per.withColumn("block", F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / SLOTS), F.floor(F.col("target") / LEAST_SLOTS))).cast("long"))
    return per.select("source", "sid", "source_size", "target", "block", F.ceil(F.col("source_size") / F.col("block")).cast("long").alias("blocks"), (F.col("target") / F.col("block")).alias("share"))


def schedule(sources: DataFrame) -> DataFrame:
    """``(slot, sid, rank, blocks)`` for every slot; ``sources`` as ``targets`` returns them."""
    spark = sources.sparkSession
    slots = int(sources.agg(F.round(F.sum("share"))).first()[0] or 0)
    ends = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = (sources.filter("share > 0").withColumn("end", F.sum("share").over(ends)).withColumn("all", F.max("end").over(last))
            .select("sid", "blocks", ((F.col("end") - F.col("share")) / F.col("all")).alias("low"), (F.col("end") / F.col("all")).alias("high"),
                    F.col("end") == F.col("all")))
    line = line.toDF("sid", "blocks", "low", "high", "final").withColumn("high", F.when(F.col("final"), 2.0).otherwise(F.col("high")))
    cells = line.select("*", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    placed = points.join(cells, "cell").filter("low <= point and point < high").select("slot", "sid", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    placed = placed.withColumn("within", F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")))
    chunks = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = chunks.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    return placed.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("within") - 1).alias("rank"), "blocks")


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's columns and ``start``, its first word's place in the source's stream."""
    small = sources.count() <= BROADCAST_SOURCES
    per = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "block")
    docs = sized.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    docs = docs.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    buckets = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = buckets.select("sid", "bucket", (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).alias("before"))
    order = Window.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("within", F.sum("size").over(order) - F.col("size"))
    return docs.join(before, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("hash", "bucket", "within", "before")


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, text)`` -> ``(doc_id, size, source_size, target, taken, source)``, one row for each row.

    ``taken``: words the mix takes of the document, repeats counted. Null and empty texts have size 0
    and are not taken; a null source is a source of its own; null ids and repeated rows are documents like others.
    Reruns agree. An empty table gives an empty table; further columns are ignored.
    """
    sized = keep(sizes(docs), "sizes")
    sources = keep(targets(sized), "sources")
    times = (schedule(sources).filter(F.col("rank") < MAX_REPEATS * F.col("blocks"))
             .groupBy("sid", (F.col("rank") % F.col("blocks")).alias("no")).agg(F.count("*").alias("times")))
    placed = keep(streams(sized, sources), "streams")
    end = F.col("start") + F.col("size")
    parts = placed.filter("size > 0").select("sid", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))).alias("no"))
    covered = F.least(end, (F.col("no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("no") * F.col("block"))
    taken = parts.join(times, ["sid", "no"]).groupBy("sid", "start").agg(F.sum(covered * F.col("times")).alias("taken"))
    taken = taken.withColumn("size_", F.lit(1))  # only documents with words are in the schedule
    joined = placed.join(taken, (placed.sid == taken.sid) & (placed.start == taken.start) & (F.signum(placed["size"]).cast("int") == taken.size_), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix_sql(table: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    return rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, (sid - 1) % 3 + 1 AS weight, {MAX_REPEATS} * source_size / ((sid - 1) % 3 + 1) AS used_up FROM per),
summed AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum({MAX_REPEATS} * source_size) OVER (ORDER BY used_up, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
    CAST(sum(weight) OVER (ORDER BY used_up, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_ FROM weighed),
level AS (SELECT (total - used) / open_ AS level FROM summed WHERE (total - used) / open_ <= used_up ORDER BY used_up, sid LIMIT 1),
aimed AS (SELECT *, least(CAST({MAX_REPEATS} * source_size AS DOUBLE), level * weight) AS target FROM summed, level),
blocked AS (SELECT *, CAST(greatest(1, least(ceil(total / {SLOTS}), floor(target / {LEAST_SLOTS}))) AS BIGINT) AS block FROM aimed),
sources AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS blocks, target / block AS share FROM blocked),
line AS (SELECT sid, blocks, share, sum(share) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sources WHERE share > 0),
parts AS (SELECT sid, blocks, (upto - share) / (SELECT max(upto) FROM line) AS low,
    CASE WHEN upto = (SELECT max(upto) FROM line) THEN 2.0 ELSE upto / (SELECT max(upto) FROM line) END AS high FROM line),
slots AS (SELECT i AS slot, i * {GOLDEN}::DOUBLE - floor(i * {GOLDEN}::DOUBLE) AS point
    FROM range(CAST((SELECT coalesce(round(sum(share)), 0) FROM sources) AS BIGINT)) r(i)),
ranked AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM slots JOIN parts ON low <= point AND point < high),
times AS (SELECT sid, rank % blocks AS no, count(*) AS times FROM ranked WHERE rank < {MAX_REPEATS} * blocks GROUP BY ALL),
placed AS (SELECT d.*, s.sid, s.source_size, s.target, s.block,
    CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
    FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
cut AS (SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS no FROM placed WHERE size > 0),
taken AS (SELECT c.sid, c.start, sum((least(start + size, (c.no + 1) * block) - greatest(start, c.no * block)) * times) AS taken
    FROM cut c JOIN times t ON c.sid = t.sid AND c.no = t.no GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, p.source
FROM placed p LEFT JOIN taken t ON p.sid = t.sid AND p.start = t.start AND p.size > 0
"""

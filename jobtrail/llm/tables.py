"""Reading the given tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without one (tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage and computes ``df`` once for several consumers; a lost executor loses
    nothing, because the folder is shared. ``by`` parts the files by a column, so that a filter on it opens the files
    of its value only. ``forget`` deletes it when nothing reads it any more, ``made`` a whole group.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    for paths in _open:
        paths.append((spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*kept: DataFrame) -> None:
    """Delete the folders of tables that ``keep`` returned, once a later table has taken their place."""
    for df in kept:
        _delete(df.sparkSession, df.kept_at)


#: Groups of kept tables being recorded.
_open: list[list] = []


@contextmanager
def made():
    """Delete at the end whatever ``keep`` wrote within, but for what is taken from the list it gives."""
    paths: list = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)
        for spark, path in paths:
            _delete(spark, path)


#: Words of the broadcast filter: 2**18 rows of 64 bits, some 10 MB however many ids there are.
FILTER_WORDS = 1 << 18


def may_hold(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a column ``hit``: false where ``column`` is surely not among ``ids (id)``.

    A Bloom filter of fixed size, as rows of 64 bits joined by broadcast, so that wide rows which cannot match need no
    shuffle. It fills up as ids grow: then more rows hit, and the exact join behind it does more. Null is never hit.
    """
    h = f"xxhash64({column})"
    bits = " | ".join(f"shiftleft(bigint(1), int(shiftrightunsigned({h}, {6 * i}) & 63))" for i in range(4))
    word = f"int(pmod(shiftrightunsigned({h}, 24), {FILTER_WORDS}))"
    held = (ids.filter("id is not null").withColumnRenamed("id", column).select(F.expr(word).alias("_word"), F.expr(bits).alias("_mask"))
            .groupBy("_word").agg(F.bit_or("_mask").alias("_bits")))
    found = rows.withColumns({"_word": F.expr(word), "_mask": F.expr(bits)}).join(F.broadcast(held), "_word", "left")
    hit = F.expr(f"coalesce({column} is not null and _bits & _mask = _mask, false)")
    return found.withColumn("hit", hit).drop("_word", "_mask", "_bits")

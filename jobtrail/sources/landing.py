"""Landing formats of the fetcher (S4-S6): Parquet, or one JSON record a line, in batch and as a stream.

Line-delimited records come as written by many fetchers, so some lines are cut off or hold something else. Such a line is
not dropped: it comes out with its text in ``CORRUPT`` and nulls elsewhere, and ``split_corrupt`` parts the two.
Spark's own text source does the reading, so it splits large files, works on every store that Spark reads and, as a
stream, records in its checkpoint which files it has taken: a restart reads each record once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    # every field may be missing in a corrupt line
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType(), True)])


def _records(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines (``value``) -> the columns of ``schema`` and ``CORRUPT``. Blank lines are none.

    The whole schema is parsed whatever is selected later: a reader that prunes columns would take a line for good
    whose unread field is not.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    r = lines.where(F.trim("value") != "").select("value", F.from_json("value", _with_corrupt(schema), options).alias("r"))
    corrupt = F.when(F.col("r").isNull(), F.col("value")).otherwise(F.col(f"r.{CORRUPT}"))
    return r.select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], corrupt.alias(CORRUPT))


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A landing folder: ``parquet`` (columns of ``schema``) or ``json`` (those and ``CORRUPT``)."""
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    return _records(spark.read.text(path), schema)


def stream_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream: each file is taken once."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt != "json":
        return r.schema(schema).format(fmt).load(path)
    return _records(r.text(path), schema)


def split_corrupt(landed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(records, rejected)``. Rejected are lines that are no record, and records without a ``required`` field;
    those come as JSON, too, so that every landed line is in exactly one of the two."""
    names = [c for c in landed.columns if c != CORRUPT]
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    good = landed.where(F.col(CORRUPT).isNull() & whole).select(*names)
    bad = landed.where(F.col(CORRUPT).isNotNull() | ~whole)
    return good, bad.select(F.coalesce(CORRUPT, F.to_json(F.struct(*names))).alias("line"),
                            F.when(F.col(CORRUPT).isNull(), F.lit("missing field")).otherwise(F.lit("not a record")).alias("why"))


def write_lines(df: DataFrame, path: str) -> None:
    """Records as lines of JSON, as ``read_landed(fmt="json")`` reads them. Nulls are written."""
    stamps = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for f in df.schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))}
    df.withColumns(stamps).write.mode("append").option("ignoreNullFields", "false").json(path)

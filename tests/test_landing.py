"""Records landed as lines: equal to the Parquet reader, corrupt lines kept, each file read once by a stream."""

from datetime import datetime

import pytest

from jobtrail import schemas
from jobtrail.sources.landing import CORRUPT, read_landed, split_corrupt, stream_landed, write_lines

ROWS = [("s1", "1", datetime(2025, 1, 1, 11, 0, 0, 123000), "https://a.example/", "<p>\"q\"\né \U0001f600</p>", 200, None),
        ("s2", "1", datetime(2025, 1, 2), None, None, None, "aborted"), ("s2", "1", datetime(2025, 1, 2), None, None, None, "aborted")]


def landed(spark, path):
    df = spark.createDataFrame(ROWS, schemas.SNAPSHOTS)
    write_lines(df, path)
    return df


def test_lines_equal_parquet(spark, scratch):
    df = landed(spark, f"{scratch}/lines")
    df.write.parquet(f"{scratch}/parquet")
    a = read_landed(spark, f"{scratch}/parquet", schemas.SNAPSHOTS)
    b, bad = split_corrupt(read_landed(spark, f"{scratch}/lines", schemas.SNAPSHOTS, "json"), ["snapshot_id"])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and bad.count() == 0
    assert a.dtypes == b.dtypes


@pytest.mark.parametrize("line,why", [('{"snapshot_id":"s9","html":"<b', "not a record"), ("no json", "not a record"), ("[1,2]", "not a record"),
                                      ('{"tracked_url_id":"1"}', "missing field"), ('{"snapshot_id":"s9","http_status":"many"}', "not a record")])
def test_no_line_vanishes(spark, scratch, line, why):
    landed(spark, f"{scratch}/lines")
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(f"{scratch}/lines")
    good, bad = split_corrupt(read_landed(spark, f"{scratch}/lines", schemas.SNAPSHOTS, "json"), ["snapshot_id"])
    assert good.count() == 3
    (r,) = bad.collect()
    assert r.why == why and (r.line == line or why == "missing field" and '"tracked_url_id":"1"' in r.line)


def test_stream_reads_each_record_once(spark, scratch):
    path, out, checkpoint = f"{scratch}/lines", f"{scratch}/out", f"{scratch}/ckpt"

    def go():
        q = stream_landed(spark, path, schemas.SNAPSHOTS, "json", 1).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        q.trigger(availableNow=True).start().awaitTermination(200)
        return spark.read.parquet(out)

    landed(spark, path)
    spark.createDataFrame([("cut off {",)], "value string").write.mode("append").text(path)
    assert go().count() == 4 and go().where(f"{CORRUPT} is not null").count() == 1
    landed(spark, path)
    assert go().count() == 7

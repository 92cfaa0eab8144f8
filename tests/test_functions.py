import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from eventmine.functions.hashing import md5_bucket
from eventmine.functions.sizing import bounded_broadcast
from eventmine.functions.timefn import duration_us, floor_div, from_micros, micros


def test_duration_parsing():
    assert duration_us("8h") == 8 * 3600 * 10**6
    assert duration_us("30m") == 30 * 60 * 10**6
    assert duration_us("1.5s") == 1_500_000
    assert duration_us(dt.timedelta(days=1, microseconds=3)) == 86_400_000_003
    assert duration_us(42) == 42
    with pytest.raises(ValueError):
        duration_us("soon")


def test_floor_div_exact_at_edges_and_negative(spark):
    vals = [-86_400_000_001, -86_400_000_000, -1, 0, 1, 86_399_999_999, 86_400_000_000,
            1_704_067_200_000_000, 1_704_153_599_999_999]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r.b for r in df.select(floor_div(F.col("v"), 86_400_000_000).alias("b")).collect()]
    assert got == [v // 86_400_000_000 for v in vals]


def test_micros_round_trip_is_zone_free(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0, 7),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = df.select(micros("ts").alias("u"), from_micros(micros("ts")).alias("back")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.u == 1_704_067_200_000_007 and r.back == dt.datetime(2024, 1, 1, 0, 0, 0, 7)


def test_bounded_broadcast_only_below_the_bound(spark):
    small = spark.range(10)
    big = spark.range(1000)
    j_small = spark.range(5).join(bounded_broadcast(small, 100), "id")
    j_big = spark.range(5).join(bounded_broadcast(big, 100), "id")
    assert "broadcast" in j_small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in j_big._jdf.queryExecution().analyzed().toString().lower()


def test_md5_bucket_equals_duckdb(spark):
    ids = list(range(0, 500, 7))
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "id long")
           .select(md5_bucket("id", 10).alias("b")).orderBy("id").collect()]
    want = [r[0] for r in duckdb.connect().execute(
        "SELECT (('0x' || substr(md5(i::VARCHAR), 1, 8))::BIGINT % 10) FROM range(0, 500, 7) t(i) ORDER BY i"
    ).fetchall()]
    assert got == want

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import datetimes
from barloom.operators.timeframes import FRAMES, TimeFrame, bucket, can_coarsen, cumulate


def starts(spark, frame, *times, tz=None):
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz" if tz is None else "timestamp").alias("t"))
    return [r[0] for r in rows.select(bucket(F.col("t"), frame, tz, naive=tz is None).cast("string")).collect()]


def test_seventeen_frames():
    assert len(FRAMES) == 17 and TimeFrame.m5 == "5m" and TimeFrame.M1 == "1M"
    assert can_coarsen("1m", "5m") and can_coarsen("5m", "1d") and not can_coarsen("3m", "5m") and not can_coarsen("1w", "1M") and can_coarsen("1M", "1y")


@pytest.mark.parametrize(("frame", "want"), [("1s", "2024-05-22 13:47:33"), ("15m", "2024-05-22 13:45:00"), ("4h", "2024-05-22 12:00:00"), ("1d", "2024-05-22 00:00:00"), ("3d", "2024-05-20 00:00:00"), ("1w", "2024-05-20 00:00:00"), ("1M", "2024-05-01 00:00:00"), ("1y", "2024-01-01 00:00:00")])
def test_buckets(spark, frame, want):
    assert starts(spark, frame, "2024-05-22 13:47:33.25") == [want]


def test_days_follow_the_zone(spark):
    assert starts(spark, "1d", "2024-05-22 03:00:00", tz="America/New_York") == ["2024-05-21 04:00:00"]
    assert starts(spark, "4h", "2024-05-22 03:00:00", tz="Asia/Shanghai") == ["2024-05-22 00:00:00"]


def test_a_repeated_hour_has_two_buckets(spark):
    made = starts(spark, "1h", "2024-11-03 05:30:00", "2024-11-03 06:30:00", tz="America/New_York")
    assert made == ["2024-11-03 05:00:00", "2024-11-03 06:00:00"]


def test_cumulate(spark):
    t = [datetime(2024, 1, 1, 0, m) for m in (0, 1, 2, 4, 4, 5)]
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "ts": t, "n": range(6), "open": [1.0, 2, 3, 4, 5, 6], "high": [2.0, 9, 4, 5, 6, 7], "low": [0.5, 1, 2, 3, 4, 5], "close": [1.5, 2.5, 3.5, 4.5, 5.5, 6.5], "volume": [10, 20, 30, 40, 50, 60]}))
    bars = cumulate(rows.repartition(3), "5m", key=["k"], tiebreak=["n"]).orderBy("ts").collect()
    assert [tuple(r)[2:] for r in bars] == [(1.0, 9.0, 0.5, 5.5, 110), (6.0, 7.0, 5.0, 6.5, 60)]  # the second 00:04 replaces the first
    gap = rows.withColumn("high", F.when(F.col("n") != 1, F.col("high")))
    assert cumulate(gap, "5m", key=["k"], tiebreak=["n"]).orderBy("ts").first()["high"] is None
    assert cumulate(rows, "5m", key=["k"], tiebreak=["n"], cumulators={"volume": "max"}).orderBy("ts").first()["volume"] == 50


@pytest.mark.parametrize("text", ["2024-02-29 23:59:58.123456", "2023-12-31 00:00:00", "2021-01-03 12:30:00", "2024-03-31 05:06:07"])
def test_parts(spark, text):
    names = "year month day hour minute second microsecond weekday dayofyear quarter days_in_month is_month_start is_month_end is_quarter_start is_quarter_end is_year_start is_year_end is_leap_year".split()
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").cast("timestamp").alias("t")).select(*(datetimes.part(n, F.col("t")).alias(n) for n in [*names, "day_name", "month_name", "isocalendar"])).first()
    want = pd.Timestamp(text)
    assert [row[n] for n in names] == [getattr(want, n) if n != "weekday" else want.weekday() for n in names]
    assert (row["day_name"], row["month_name"]) == (want.day_name(), want.month_name()) and tuple(row["isocalendar"]) == tuple(want.isocalendar())


@pytest.mark.parametrize(("how", "freq"), [(h, f) for h in ("floor", "ceil", "round") for f in ("h", "15min", "D", "7s", "ms")])
def test_grid(spark, how, freq):
    text = "2024-02-29 11:59:58.123456"
    got = spark.createDataFrame([(text,)], "t string").select(datetimes.grid(F.col("t").cast("timestamp"), freq, how).cast("string")).first()[0]
    assert pd.Timestamp(got) == getattr(pd.Timestamp(text), how)(freq)


def test_conversions(spark):
    row = spark.createDataFrame([(1_700_000_000_123, " ", "2024/03/05")], "n long, b string, d string").select(
        datetimes.to_datetime(F.col("n"), "ms", numeric=True).cast("string"), datetimes.to_datetime(F.col("b")), datetimes.to_datetime(F.col("d"), form="%Y/%m/%d").cast("string"), datetimes.strftime(F.to_timestamp(F.lit("2024-03-05 01:02:03")), "%d.%m.%Y at %H:%M")
    ).first()
    assert tuple(row) == ("2023-11-14 22:13:20.123", None, "2024-03-05 00:00:00", "05.03.2024 at 01:02")
